"""Whitening, fill-in-middle and fingerprints against brute force, SQL, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import fill_in_middle, order_minhash, registry, whitening

ODD = [
    (1, None), (2, ""), (3, "   \n "), (4, "word"), (5, "a " * 3000), (6, "a " * 3000), (7, "x" * 20000), (8, "1234567890 " * 400), (10, "Grüße 中文 😀\t▁ \x00 tail  two　three\x1c \x0b"),
    (11, "one two"), (11, "one two"), (11, "another"), (None, "null id"), (None, "second null id"), (-5, "minus"), (12, "has <P> inside"), (13, "<S>"), (14, "a<M"), (15, "<P"), *[(i, f" word{i} <S <  é{i} 😀 end{'!' * (i % 7)}  ") for i in range(100, 180)],
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.select("*", *[F.lit("z").alias(c) for c in ("lang", "source", "n_chars", "n", "form", "output", "raw", "h1", "given", "id", "h", "place", "after", "fingerprint")])


def normal(rows):
    return Counter(map(tuple, rows))


# --- fill in middle


def cut_plainly(doc_id, text, seed=42):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("width", [1, 3, 16, 1024])
def test_fill_in_middle_brute_force(odd, width):
    made = fill_in_middle.fill_in_middle(odd, width=width)
    assert normal(made.collect()) == Counter(cut_plainly(*r) for r in ODD)
    back = made.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("t"))
    assert normal(back.collect()) == Counter((i, t or "") for i, t in ODD)
    assert {r["form"] for r in made.collect()} == {"plain", "spm", "psm"}


def test_fill_in_middle_all_forms(odd):
    for share, first in ((100, 0), (100, 100), (0, 50)):
        made = fill_in_middle.fill_in_middle(odd, share=share, suffix_first=first)
        back = made.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("t")).collect()
        assert normal(back) == Counter((i, t or "") for i, t in ODD)
        cut = {r["form"] for r in made.collect()} - {"plain"}
        assert cut == (set() if not share else {"spm"} if first else {"psm"})
    assert fill_in_middle.fill_in_middle(odd.where("false")).count() == 0


def test_blocks_find_every_cut():
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice(" \tab中é😀\n") for _ in range(draw.randrange(90)))
        t, units = fill_in_middle.Blocks(text.encode(), draw.choice([1, 2, 5, 64])), re.findall(r"[ \t\n]*[^ \t\n]+|[ \t\n]+", text)
        assert (t.n, t.chars) == (len(units), len(text))
        for i in range(len(units) + 1):
            head = "".join(units[:i])
            assert t.end_of(i) == (len(head.encode()), len(head))


@pytest.mark.parametrize("name", ["op12_fill_in_middle"])
def test_sql(spark, medium, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{medium}/documents.parquet'")
    rel, got = con.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, medium)
    assert rel.columns == got.columns and normal(got.collect()) == normal(rel.fetchall())


# --- fingerprints


def plain_fingerprint(s, text):
    """The definition, with the sketcher's hash functions."""
    kmers = s.kmers(order_minhash._points(text)).tolist()
    seen, named = Counter(), []
    for x in kmers:
        named.append(int(order_minhash._mixed(np.array([x], np.uint64) + np.array([seen[x]], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]) >> 32)
        seen[x] += 1
    out = []
    for add, mul in zip(s.add[:, 0].tolist(), s.mul[:, 0].tolist(), strict=True):
        chosen = sorted(sorted(range(len(named)), key=lambda i: ((named[i] ^ add) * mul % (1 << 32), i))[: s.size])
        h = np.zeros(1, np.uint64)
        for i in chosen:
            h = order_minhash._mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kmers[i]) + np.uint64(1))
        out.append(f"{int(h[0]) >> 32:08x}")
    return "".join(out)


@pytest.mark.parametrize("at_once", [3, 7, 4096])
def test_fingerprint_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(order_minhash, "AT_ONCE", at_once)
    for k, size in ((1, 1), (3, 2), (5, 3)):
        s = order_minhash.Sketcher(k, size, 16)
        for t in ("", "a", "ab", "aaaaaaaaaaaa", "abcabcabcabd", "Grüße 中文 😀 " * 4):
            assert s.fingerprint(order_minhash._points(t)) == plain_fingerprint(s, t)


def test_order_counts():
    words = [hashlib.md5(bytes([i])).hexdigest()[:7] + " " for i in range(200)]
    a, b = "".join(words), "".join(words[100:] + words[:100])
    swapped = "".join(reversed(words))
    alike = lambda x, y, size: (lambda s: sum(p == q for p, q in zip(*(re.findall(".{8}", s.fingerprint(order_minhash._points(t))) for t in (x, y)), strict=True)) / 64)(order_minhash.Sketcher(5, size, 64))
    assert alike(a, b, 1) > 0.9 and 0.3 < alike(a, b, 2) < 0.8 and alike(a, swapped, 2) < 0.1  # the same k-mers, in another order


def neighbours_plainly(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    return order


def test_next_brute_force(spark, odd, monkeypatch):
    rows = [r for r in ODD if r[0] is not None and r[0] != 11]  # ids that name one row
    order = neighbours_plainly(rows)
    want = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        want[i] = (len(t), t[: len(t) - cut] + u[:cut], u)
    s = order_minhash.Sketcher()
    prints = lambda t: s.fingerprint(order_minhash._points(t))
    for size in (32 << 20, 40):  # few ranges, a range for every row or two
        monkeypatch.setattr(order_minhash, "RANGE_BYTES", size)
        got = {r["doc_id"]: r for r in order_minhash.with_next(odd.where("doc_id <> 11")).collect()}
        assert got.keys() == want.keys()
        for i, t in rows:
            n, edited, after = want[i]
            assert tuple(got[i])[1:] == (n, edited, prints(t or ""), prints(edited), prints(after))
        every = order_minhash.with_next(odd).select("doc_id", "n_chars", "fingerprint").collect()
        assert normal(every) == Counter((i, len(t or ""), prints(t or "")) for i, t in ODD)
    one = order_minhash.with_next(odd.where("doc_id = 4")).first()
    assert (one["edited"], one["next_fingerprint"]) == ("worw", prints("word"))
    assert order_minhash.with_next(odd.where("false")).count() == 0
    assert normal(order_minhash.fingerprints(odd).collect()) == Counter((i, prints(t or "")) for i, t in ODD)


def test_many_equal_rows(spark):
    docs = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text here").alias("text")).unionByName(spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    got = order_minhash.with_next(docs).collect()
    assert len(got) == 320 and sum(r["doc_id"] == 7 for r in got) == 301 and sum(r["fingerprint"] == r["next_fingerprint"] for r in got) == 299


def test_fingerprints_tell_edits_from_others(spark, medium):
    got = order_minhash.op13_document_fingerprints(spark, medium).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    ids = sorted(text)
    by_text = {}
    for r in got:
        t, u = text[r["doc_id"]], text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] > r["near_next"] or t == u)
    assert min(r["near_edited"] for r in got) > 0.1 and np.median([r["near_edited"] for r in got]) > 0.3


# --- whitening


def whitened(df, components=16):
    out, w = whitening.whiten(df, components)
    return out.orderBy("vec_id", "component").collect(), w


def check_against_numpy(rows, got, w, components=16):
    kept = [(i, v) for i, v in rows if v]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    e, q = e[::-1], q[:, ::-1]
    c = min(components, int((e > 1e-9 * e[0]).sum()))
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in kept for _ in range(c))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for j in range(c):
        assert math.isclose(got[j]["explained"], e[j] / e.sum(), rel_tol=1e-9) and got[j]["identity_error"] < 1e-9
    for (i, _), row in zip(kept, x, strict=True):
        assert by[i][1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) and by[i][1]["n"] == n
    return kept, x - s / n, e, q, by, c


def test_whitening_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), (draw.standard_normal(20) * np.linspace(2, 0.2, 20)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third of the rows are copies
    bad = [(5000, None), (5001, [None] + [0.5] * 19), (5002, [float("nan")] * 20), (5003, [float("inf")] + [0.0] * 19), (5004, [1.0]), (5005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").select("*", *[F.lit("z").alias(c) for c in ("label", "n", "x", "v", "i", "component")])
    got, w = whitened(df)
    kept, y, e, q, by, c = check_against_numpy(rows, got, w)
    assert c == 16 and w.centre.n == 400
    z = y @ q[:, :16] / np.sqrt(e[:16])
    mine = np.array([[by[i][j + 1]["whitened"] for j in range(16)] for i, _ in kept])
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-8


def test_whitening_of_equal_variances_and_short_ranks(spark):
    corners = [(i, [float(2 * (i >> b & 1) - 1) for b in range(5)] + [1.0, float(2 * (i & 1))]) for i in range(32)]  # equal variances, a constant, a copy of a column
    df = spark.createDataFrame(corners, "vec_id long, embedding array<double>")
    got, w = whitened(df)
    _, y, e, q, by, c = check_against_numpy(corners, got, w)
    assert c == 5
    z = np.array([[by[i][j + 1]["whitened"] for j in range(5)] for i, _ in corners])
    assert np.abs(z.T @ z / 32 - np.eye(5)).max() < 1e-12
    assert np.linalg.norm(w.components.T @ w.components - np.eye(5)) < 1e-12


def test_whitening_stops_early(spark):
    draw = np.random.default_rng(4)
    scale = np.array([900.0, 700.0, 500.0, *[0.4] * 77])
    rows = [(int(i), (draw.standard_normal(80) * scale).tolist()) for i in range(300)]
    got, w = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    assert w.steps < 40
    check_against_numpy(rows, got, w, 2)


def test_whitening_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]):
        assert whitened(spark.createDataFrame(rows, schema))[0] == []
    got, w = whitened(spark.createDataFrame([(1, [0.0, 2.0]), (1, [1.0, 2.0])], schema))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in got] == [(1, 1, 2, 64 * 64, 1.0, 1.0)] * 2
    far, _ = whitened(spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema))
    assert len(far) == 3 and far[0]["deviation"] is None
