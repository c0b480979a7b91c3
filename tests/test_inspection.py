"""Inspection, pages, sketches, packing and sources on small, empty and odd tables."""

import random
import re
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import governance, ingest, inspection, neighbours, quality, reports, sketches
from corpuslens.sources import tables


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_csv_tables_with_quotes_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n , ,\nname,"note, more"\n"Smith, J",ok\n\n"say ""hi""", x y \n,,\nlast,\n')
    (tmp_path / "b.csv").write_text("only head\n")
    (tmp_path / "c.csv").write_text("")
    r = tables.csv_tables(spark, str(tmp_path / "*.csv"), rows=2).orderBy("block").collect()
    assert [x["text"] for x in r] == ['| name | note, more |\n| --- | --- |\n| Smith, J | ok |\n| say "hi" | x y |', "| name | note, more |\n| --- | --- |\n| last |  |"]


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    schema = "chunk_id string, vector array<double>, n int"
    stored = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 0)], schema)
    new = spark.createDataFrame([("a", [3.0, 4.0], i) for i in (3, 8, 1, 5)] + [("c", [0.0, 0.0], 1), ("d", None, 1)], schema).repartition(4)
    out = got(tables.upsert(stored, new, order="n"), "chunk_id", "vector", "n")
    assert out == [("a", [0.6, 0.8], 8), ("b", [0.0, 1.0], 0), ("c", [0.0, 0.0], 1), ("d", None, 1)]
    assert got(tables.upsert(stored, new), "chunk_id", "n") == got(tables.upsert(stored, new.repartition(1)), "chunk_id", "n")
    assert got(tables.upsert(stored, new.where("false")), "chunk_id", "n") == [("a", 0), ("b", 0)]


def test_append_of_a_run_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1), ("u", 2)], "tenant_id string, x int")
    for run in ("r1", "r1", "r2"):
        tables.append_rows(rows, str(tmp_path / "log"), run=run)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_files_and_partitions(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# T\n\nbody\n")
    assert [r["text"] for r in tables.text_documents(spark, str(tmp_path / "d")).collect()] == ["# T\n\nbody\n"]
    (tmp_path / "g.json").write_text('{"version": 1, "items": [{"id": "g01", "query": "q", "relevant_chunk_ids": ["c"], "negative": false}]}')
    assert got(tables.golden_items(spark, str(tmp_path / "g.json")), "id", "query") == [("g01", "q")]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "kb_id string, x int")
    path = str(tmp_path / "p")
    tables.write_partitions(rows, path)
    tables.write_partitions(rows.where("kb_id = 'a'").withColumn("x", F.lit(9)), path)
    assert got(spark.read.parquet(path), "kb_id", "x") == [("a", 9), ("b", 2)]
    assert got(tables.remove_by_key(rows, rows.where("x = 1"), ["kb_id"]), "x") == [(2,)]


def test_alert_types(spark):
    issues = spark.createDataFrame([("k", "zero_vector", "high"), ("k", "isolated_query", "high"), ("k", "duplicate_chunk", "high"), ("k", "missing_vector", "medium")], "kb_id string, issue_type string, severity string")
    r = quality.kb_scores(issues, spark.createDataFrame([("k", 100), ("l", 5)], "kb_id string, n_chunks int"))
    assert got(r, "kb_id", "high_count", "score") == [("k", 2, 95.8), ("l", 0, 100.0)]
    rows = [(1, "t", "k", 1, 95.0, 1), (2, "t", "k", 2, 79.9, 2), (3, "t", "k", 3, 90.0, 0), (4, "t", "k", 4, 90.0, 1)]
    a = quality.alerts(spark.createDataFrame(rows, "report_id int, tenant_id string, kb_id string, created_at int, score double, high_count int"))
    assert got(a, "report_id", "alert_type") == [(1, "new_high_severity"), (2, "low_score"), (2, "new_high_severity"), (4, "new_high_severity")]


def test_vector_issues_health_and_tasks(spark):
    chunks = spark.createDataFrame([("c1", "k", 1), ("c2", "k", 1), ("c3", "k", 2), ("c4", "l", 3)], "chunk_id string, kb_id string, doc_id long")
    vectors = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [0.0, 0.0]), ("c4", None), ("gone", [0.0, 0.0])], "chunk_id string, vector array<double>")
    issues = quality.vector_issues(chunks, vectors)
    assert got(issues, "chunk_id", "issue_type", "severity") == [("c2", "zero_vector", "high"), ("c3", "missing_vector", "medium"), ("c4", "missing_vector", "medium")]
    assert got(inspection.vector_health(chunks, vectors), "kb_id", "checked", "missing", "zero", "completeness") == [("k", 3, 1, 1, 0.6667), ("l", 1, 1, 0, 0.0)]
    assert inspection.vector_health(chunks.where("false"), vectors).count() == 0
    named = issues.join(chunks, "chunk_id")
    t = quality.tasks_from_issues(named, spark.createDataFrame([], "task_type string, doc_id long"), {"zero_vector": "embed"}, F.lit("2024-01-01").cast("timestamp"))
    assert got(t, "task_type", "doc_id", "due_date") == [("embed", 1, datetime(2024, 1, 15))]


def test_reports_coverage_and_gates(spark):
    none = spark.createDataFrame([], "kb_id string, issue_type string, severity string")
    sizes = spark.createDataFrame([("k", 10), ("l", 0)], "kb_id string, n_chunks long")
    clean = inspection.reports(none, sizes).collect()
    assert {(r["scope"], r["kb_id"], r["score"], r["issue_count"], tuple(r["suggestions"])) for r in clean} == {("kb", "k", 100.0, 0, ("keep inspecting",)), ("kb", "l", 100.0, 0, ("keep inspecting",)), ("all", "", 100.0, 0, ("keep inspecting",))}
    some = spark.createDataFrame([("k", "zero_vector", "high"), ("k", "tiny_chunk", "low"), (None, "domain_coverage_gap", "high"), ("k", None, "low")], none.schema)
    r = {x["kb_id"]: x for x in inspection.reports(some, sizes).collect()}
    assert (r["k"]["score"], r["k"]["high_count"], r["k"]["issue_counts"]) == (86.0, 1, ["tiny_chunk:1", "zero_vector:1"])
    assert (r[""]["score"], r[""]["issue_count"], r[""]["suggestions"]) == (74.0, 3, ["split by clauses", "embed again", "add documents of the domain"])
    chunks = spark.createDataFrame([("k", "case")] * 5 + [("k", "standard")] + [("k", None)], "kb_id string, domain string")
    recall = spark.createDataFrame([("a", 0.2), ("b", 0.9)], "intent string, recall double")
    routes = spark.createDataFrame([("a", ["case", "other"]), ("b", ["standard"])], "intent string, domains array<string>")
    c = inspection.coverage(chunks, recall, routes)
    assert got(c, "domain", "n_chunks", "low_intents", "sparse", "severity") == [("case", 5, ["a"], True, None), ("enterprise", 0, [], True, "high"), ("other", 0, ["a"], True, "high"), ("standard", 1, [], True, "medium")]
    assert got(inspection.coverage_issues(c), "domain") == [("enterprise",), ("other",), ("standard",)]
    kbs, health = spark.createDataFrame([("k",), ("new",)], "kb_id string"), spark.createDataFrame([("k", 0, 1)], "kb_id string, missing long, zero long")
    latest = spark.createDataFrame([("k", 70.0)], "kb_id string, score double")
    g = {x["kb_id"]: x for x in inspection.gates(kbs, chunks, health, latest, ("case",)).collect()}
    assert (g["k"]["reasons"], g["k"]["note"], g["k"]["overall"]) == (["score_low", "vectors_zero"], None, False)
    assert (g["new"]["reasons"], g["new"]["note"] is not None, g["new"]["completeness"]) == (["domain_empty"], True, 1.0)


def test_gaps_tasks_and_kpis(spark):
    queries = spark.createDataFrame([(1, "roof leak", "i", ["case"]), (2, "x", None, None)], "query_id long, query string, intent string, domains array<string>")
    issues = spark.createDataFrame([(1, "isolated_query"), (1, "isolated_query"), (3, "isolated_query"), (2, "other")], "query_id long, issue_type string")
    asked = inspection.isolated_questions(issues, queries, F.lit("2024-02-01").cast("timestamp"))
    old = spark.createDataFrame([("leak roof", 4, datetime(2024, 1, 1), "open", "old words", "o", None), ("z", 1, datetime(2024, 1, 1), "rejected", "z", "o", None)], "query_key string, n long, last_asked_at timestamp, status string, query string, intent string, domains array<string>")
    g = governance.capture_gaps(old, asked, ("query", "intent", "domains"))
    assert got(g, "query_key", "n", "status", "query", "intent", "domains") == [("leak roof", 5, "open", "roof leak", "i", ["case"]), ("z", 1, "rejected", "z", "o", None)]
    t = inspection.accepted_gaps(g, F.lit("2024-01-01").cast("timestamp"), g.where("query_key = 'z'").select("query_key")).collect()
    assert [(x["title"], x["priority"], x["due_date"], x["description"]) for x in t] == [("fill: roof leak", "high", datetime(2024, 1, 15), "asked 5 times (intent i): roof leak; add to: case")]
    r = spark.createDataFrame([(1, 1, 90.0, 3, 1), (2, 2, 61.0, 5, 2)], "report_id int, created_at int, score double, issue_count int, high_count int")
    health = spark.createDataFrame([(1, 2), (0, 1)], "missing long, zero long")
    covered = spark.createDataFrame([(True,), (False,)], "sparse boolean")
    alerts = spark.createDataFrame([(True,), (False,), (False,)], "resolved boolean")
    assert tuple(inspection.kpis(r, health, covered, alerts).first()) == (61.0, 5, 2, "fair", 4, 1, 2)
    assert tuple(inspection.kpis(r.where("false"), health.where("false"), covered.where("false"), alerts.where("false")).first())[4:] == (0, 0, 0)
    log = spark.createDataFrame([(200, "hit"), (500, None), (200, "miss"), (None, None)], "status int, cache string")
    assert tuple(inspection.request_rates(log, []).first()) == (4, 1, 0.25, 1, 2, 0.5)


def test_pages_and_seek_keys(spark):
    rows = spark.range(0, 237).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("v").alias("total_"))
    want = sorted(range(237), key=lambda i: (-(i % 7), i))
    p = reports.paged(rows, [F.desc("k"), F.col("id")], 5)
    for n in (1, 2, 7, 12, 13):
        r = p.page(n, 20).collect()
        assert [x["id"] for x in r] == want[20 * n - 20 : 20 * n] and all((x["total"], x["pages"]) == (237, 12) for x in r)
    assert reports.page_of(rows.where("false"), [F.col("id")]).count() == 0
    with pytest.raises(ValueError):
        p.page(0)
    keys, last, seen = [("k", True), ("id", False)], None, []
    while len(seen) < 237:
        r = reports.page_after(rows, keys, last, 50).collect()
        seen += [x["id"] for x in r]
        last = (r[-1]["k"], r[-1]["id"])
    assert seen == want and reports.page_after(rows, keys, last).count() == 0


def test_search_documents_by_code(spark):
    d = spark.createDataFrame([(1, "About concrete", None, False), (2, None, "GB 50010", False), (3, "gb", "", True), (4, "none", "", False)], "doc_id long, title string, standard_code string, is_deleted boolean")
    assert got(reports.search_documents(d, "gB"), "doc_id") == [(2,)] and got(reports.search_documents(d, "CONC"), "doc_id") == [(1,)]


def test_sketches_stay_within_their_error(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(draw.lognormal(3, 2, 3000))] + [(0, 0.0), (1, -5.0), (2, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    whole = sketches.sketch(df, "v", [F.col("g")])
    parts = sketches.sketch(df.where("v < 20"), "v", [F.col("g")]).unionByName(sketches.sketch(df.where("v >= 20"), "v", [F.col("g")]))
    assert got(sketches.merged(parts, ["g"]), "g", "bucket", "n") == got(whole, "g", "bucket", "n")
    every = {(r["g"], r["level"]): r for r in sketches.quantiles(sketches.merged(whole, ["g"], rollup=True), ["g", "level"]).collect()}
    for key, values in [((g, 0), [v for h, v in rows if h == g and v is not None]) for g in range(3)] + [((None, 1), [v for _, v in rows if v is not None])]:
        values.sort()
        assert every[key]["n"] == len(values)
        for q in (0.5, 0.95, 0.99):
            exact = values[int(np.ceil(q * len(values))) - 1]
            assert abs(every[key][f"p{round(q * 100)}"] - exact) <= 0.0101 * exact
    assert sketches.quantiles(whole.where("false"), ["g"]).count() == 0
    assert got(sketches.exact_quantiles(df.where("g = 0"), "v", [F.col("g")]), "n") == [(1001,)]


def packed_plainly(text, size, overlap, ends):
    if len(text) <= size:
        return [text]
    buf, out = "", []
    for s in re.split(f"(?<=[{ends}])", text):
        if not s.strip(" "):
            continue
        if len(buf) + len(s) > size and buf:
            out.append(buf)
            buf = (buf[-overlap:] if overlap else "") + s
        else:
            buf += s
    return out + [buf] if buf.strip(" ") else out


def test_packing_is_greedy_and_linear(spark):
    draw = random.Random(3)
    texts = ["", None, "   ", "no end", ";;;; ;;", *["".join(draw.choice("ab é中.;") for _ in range(draw.randrange(1, 400))) for _ in range(80)]]
    for size, overlap in ((30, 0), (30, 7), (30, 45), (5, 2)):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", ingest.pack_sentences(F.col("t"), size, overlap, ";.").alias("p"))
        for r in df.collect():
            assert r["p"] == (None if r["t"] is None else packed_plainly(r["t"], size, overlap, ";."))
    big = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("a sentence of some words; "), 800_000).alias("text"))  # 20 MB, one section
    began = time.time()
    out = ingest.chunks(big).agg(F.count("*").alias("n"), F.max("char_count").alias("m"), F.max("seq").alias("s")).first()
    assert out["n"] > 40_000 and out["s"] == out["n"] - 1 and out["m"] <= 600 and time.time() - began < 120


def test_crowds_and_groups_of_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 32))
    x = np.vstack([base, base[3] + 0.15 * rng.standard_normal((150, 32)), base[:10] + 0.1 * rng.standard_normal((10, 32)), np.repeat(base[7:8], 20, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(i, int(s[i].argmax()), float(s[i].max())) for i in range(len(x)) if s[i].max() >= 0.92}
    for block, crowd in ((2048, 64), (20, 3), (2048, 10**6)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "CROWD", crowd)
        found = set(got(neighbours.nearest_similar(df), "vec_id", "neighbour", "cosine"))
        assert len(found & want) >= 0.98 * len(want) and len(found) <= len(want)
    for n in (10, 10**5, 10**9):
        bits, tables, whole, most = neighbours.sketch_size(n, 0.92)
        off = np.arccos(0.92) / np.pi
        assert (1 - (1 - off) ** bits) ** tables <= 0.01 and whole >= bits * tables and most > whole * off


def test_scalars_and_small_operators(spark):
    from corpuslens.functions import text as T
    from corpuslens.functions import vectors
    from corpuslens.operators import evaluate, lists, search

    d = spark.createDataFrame([("a > b", "b begins"), ("a > b", "x"), ("", "x"), (None, "x")], "p string, t string")
    assert [r[0] for r in d.select(T.with_section(F.col("p"), F.col("t"))).collect()] == ["b begins", "【a > b】\nx", "x", "x"]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(vectors.norm(F.col("v"))).collect()] == [5.0, 0.0, None]
    q = spark.createDataFrame([("steel beam 3.2", "Steel beam of 3.2 m 必须"), ("steel beam", "nothing"), ("", "text")], "q string, d string")
    got_ = [round(r[0], 4) for r in q.select(search.lexical_score(F.col("q"), F.col("d"))).collect()]
    assert got_ == [round(0.55 + 0.2 * 4 / 6 + 0.25 + 0.1, 4), 0.0, 0.0]
    p = spark.createDataFrame([(1, 2, 0.5, 1.0), (2, 1, 0.0, 0.0)], "query_id int, n_relevant int, mrr double, recall_5 double")
    assert tuple(evaluate.mean_metrics(p).first()) == (2, 0.25, 0.5) and tuple(evaluate.mean_metrics(p.where("false")).first()) == (0, 0.0, 0.0)
    assert [tuple(r) for r in lists.eval_rows(p).collect()] == [(1, 2, 0.5, 1.0, True), (2, 1, 0.0, 0.0, False)]
    assert spark.range(1).select(lists.due(F.lit("2024-01-01").cast("timestamp"), 30)).first()[0] == datetime(2024, 1, 31)


def test_open_tasks_are_not_made_again(spark):
    issues = spark.createDataFrame([(1, "zero_vector", "high"), (1, "zero_vector", "high"), (2, "zero_vector", "high"), (3, "tiny_chunk", "low"), (None, "isolated_query", "high")], "doc_id long, issue_type string, severity string")
    open_ = spark.createDataFrame([("embed", 2)], "task_type string, doc_id long")
    assert got(quality.tasks_from_issues(issues, open_, {"zero_vector": "embed"}), "task_type", "doc_id", "due_days", "due_date") == [("embed", 1, 14, None)]
    assert quality.tasks_from_issues(issues.where("false"), open_, {"x": "y"}).count() == 0


def test_rerank_with_decay_counts_the_word_at_the_head(spark):
    from corpuslens.operators import search

    c = spark.createDataFrame([(1, "q q", 10, "应 do", 1, 0.5, 0.0, False, "valid"), (1, "q q", 11, "x" * 90 + "应", 2, 0.5, 0.0, False, "valid"), (1, "q q", 12, "应 必须", 3, 0.5, 0.0, False, "valid")], "query_id int, query string, doc_id int, content string, rank int, fusion_score double, cosine double, is_mandatory boolean, governance_status string")
    r = {x["doc_id"]: x["rerank_score"] for x in search.rerank(c, decay=True).collect()}
    assert r == {10: 0.1, 11: 0.0, 12: round(0.1 / 1.1, 6)}


def test_reports_and_gates_with_coalesced_parts(spark, medium):
    """Parts that Spark coalesces apart, as it does with larger tables, made a join with a union of joins fail."""
    from corpuslens.plans.registry import QUERIES

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert [len(QUERIES[n](spark, medium).collect()) for n in ("inspection_reports", "release_gates")] == [21, 21]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_issues_keep_columns_of_their_chunks(spark):
    chunks = spark.createDataFrame([("c1", "k"), ("c2", "l"), ("c3", "l"), (None, "m")], "chunk_id string, kb_id string")
    vectors = spark.createDataFrame([("c1", [0.0]), ("c2", [1.0, None]), ("c2", [2.0, 0.0])], "chunk_id string, vector array<double>")
    issues = quality.vector_issues(chunks, vectors, keep=("kb_id",))
    assert got(issues, "chunk_id", "kb_id", "issue_type") == [("c1", "k", "zero_vector"), ("c3", "l", "missing_vector"), (None, "m", "missing_vector")]
