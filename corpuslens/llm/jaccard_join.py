"""N-gram Jaccard self-join by PartEnum signatures, exact, and the components of its links.

Equal texts are compared once. A text's set holds the hashes of its distinct five-word shingles. Two sets with 100 * common >= 80 * union whose sizes
lie in one band differ in at most K elements. The hash domain is dealt into N1 parts: as more than N1 - E of them would
have to differ in more than K2 elements otherwise, at least E + 1 parts differ in at most K2; and of the N2 smaller parts
of such a part at least N2 - K2 agree. A signature is the content of N2 - K2 smaller parts, so similar sets of a band
share one. An empty signature would be shared widely; a set leaves such out unless more than E of its parts have one, which
loses nothing: one of the E + 1 parts then has none. A set stands in each band that a partner's
size can share with it.

Of the members of a signature's bucket, each is compared with the bucket's centre, the one that shares most buckets with
others; buckets with the same members count once. The links found are joined to components. What this leaves open, pairs
in one bucket that are in different components, is compared inside the bucket: its rows, sorted by size, carry their odd
bits, a bound from below on the number of elements in which two sets differ, and only pairs that these allow are compared
by whole sets. A bucket of more than BLOCK members is dealt in groups, each pair of groups to one place, so no task holds
more than two groups of it. No pair that could link is left out, at any size.

Cases: null texts and texts without words have empty sets and are linked with nothing, themselves excepted. Fewer than
five words make one shingle. Equal texts are one set, named by a hash of the text, so an id may stand on several texts;
repeated rows each get a row. Rows without id are kept, belong to a component like others and are the smallest id of
nothing: a component has no id only if none of its rows has one. Columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import only, release, saved, small_batches, table, with_small

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = 5
#: Members of a bucket that are compared in one place, and rows of a pass over small buckets.
BLOCK, ROWS = 2048, 16_384
#: Words of odd bits that a bucket's row carries at most.
NEAR = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.array([_M1, _M2, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [_WORD.findall(lowered(t)) for t in texts]
    flat = [x for w in split for x in w]
    h = hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, np.uint64)
    h = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    with np.errstate(over="ignore"):
        full = h[: len(h) - WORDS + 1] * _PLACE[0]
        for j in range(1, WORDS):
            full = full + h[j : len(h) - WORDS + 1 + j] * _PLACE[j]
        full = mix(full + np.uint64(WORDS))  # of places where a text ends as well; those are not read
        out, at = [], 0
        for k in map(len, split):
            if k >= WORDS:
                out.append(np.unique(full[at : at + k - WORDS + 1]))
            else:
                out.append(mix((h[at : at + k] * _PLACE[:k]).sum(keepdims=True) + np.uint64(k)) if k else h[:0])
            at += k
    return out


def bands(size: int) -> list[int]:
    """Bands that a set of this size stands in: its own and the one before, if a smaller partner can be there."""
    own = band_of(size)
    least = -(-4 * size // 5)
    return [own] if own == 0 or least > _EDGES[own - 1] else [own - 1, own]


#: Largest size of each band. A partner of a set is at most 1.25 times as large, so it is in the same band or the next.
_EDGES = [1, 2, 3, 4, 5]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, _EDGES[-1] * 5 // 4))


def band_of(size: int) -> int:
    return int(np.searchsorted(_EDGES, size))


@lru_cache(None)
def plan(band: int) -> tuple[int, int, int, int]:
    """E, K2, N1, N2 of a band: those with which a set seldom has more than E parts with an empty signature."""
    low, high = (_EDGES[band - 1] + 1 if band else 1), _EDGES[band]
    # The sets differ in at most (|A| + |B|) / 9 elements, and the larger is at most 1.25 times the smaller.
    k, size, best = (high + high * 5 // 4) // 9, (low + high) / 2, None
    for k2, n2 in ((0, 1), (1, 2), (1, 3), (1, 4), (2, 4), (2, 5), (3, 5), (3, 6), (4, 6), (5, 7)):
        for e in range(1 + k // 4):
            n1 = k // (k2 + 1) + 1 + e
            rows, mean = n1 * comb(n2, k2), size / n1 * (n2 - k2) / n2
            if rows > max(24, 0.45 * size):
                break
            mu = n1 * max(1e-12, min(1.0, comb(n2, k2) * exp(-mean)))
            over = 1 - sum(exp(i * log(mu) - mu - lgamma(i + 1)) for i in range(e + 1))
            rank = (round(max(over, 0.05), 2), round(-mean, 1), rows)
            if best is None or rank < best[0]:
                best = (rank, (e, k2, n1, n2))
    return best[1] if best else (0, 0, k + 1, 1)


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of one set in each of its bands."""
    out = []
    with np.errstate(over="ignore"):
        for band in bands(len(s)):
            e, k2, n1, n2 = plan(band)
            cell = ((s >> np.uint64(40)) % np.uint64(n1)).astype(np.int64) * n2 + ((s & np.uint64(0xFFFFF)) % np.uint64(n2)).astype(np.int64)
            cell = cell.astype(np.uint16) if n1 * n2 < 1 << 16 else cell  # sorted by radix
            order = np.argsort(cell, kind="stable")
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s[order] + _M2))])
            edge = np.searchsorted(cell[order], np.arange(n1 * n2 + 1))
            sums = (total[edge[1:]] - total[edge[:-1]]).reshape(n1, n2)
            count = np.diff(edge).reshape(n1, n2)
            picks = np.array(list(combinations(range(n2), n2 - k2)))
            got = sums[:, picks].sum(axis=2)
            held = count[:, picks].sum(axis=2)
            name = (np.arange(n1, dtype=np.uint64)[:, None] * np.uint64(64) + np.arange(len(picks), dtype=np.uint64)) * np.uint64(256) + np.uint64(band)
            got = mix(mix(got + name * _M1) + held.astype(np.uint64))
            weak = held == 0
            out.append(got[~weak] if weak.any(axis=1).sum() <= e else got.ravel())
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * n >= 80 * (len(a) + len(b) - n)


def odd_bits(s: np.ndarray) -> np.ndarray:
    """At least two bits for each element, each set where an odd number of elements falls, as 64-bit words: two sets differ
    in no fewer elements than in bits. The number of bits is a power of two; halves of it, joined, give those of half as many."""
    m = max(1024, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 1024
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool)).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def same_text() -> Column:
    """What equal texts, and only those, have in common."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def row_key(same: Column) -> Column:
    """What rows with one id, or none, and equal texts have in common; `same` is that of `same_text`."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.hex(same))))


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text, `node` (a hash of the text) and `place`, by which rows without id come last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.lit((1 << 63) - 1)
    return only(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64(F.lit(seed), text).alias("node"), F.coalesce("doc_id", last).alias("place"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, their rows without text, and a row for each different text; hashed anew if two texts have one hash."""
    seed = 0
    while True:
        texts = _texts(docs, seed)
        ids = saved(texts.select("doc_id", "node", "place", same_text().alias("same")), "ids")
        each = ids.groupBy("same", "node", "place").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
        first = each.groupBy("same", "node").agg(F.min("place").alias("first"), F.min("doc_id").alias("least"), F.sum("rows").alias("held"), F.min_by("rows", "place").alias("equal"))
        first = saved(first, "first")
        if first.groupBy("node").count().where("count > 1").isEmpty():
            return texts, ids, first.drop("same")
        seed += 1


def _one_of_each(texts: DataFrame, ids: DataFrame, first: DataFrame) -> DataFrame:
    """(id, text): one row of each different text. Only rows that repeat both id and text are brought together."""
    spare = saved(ids.join(first.where("held > 1").select("node", "first"), "node").where("place > first").select("node", "place").distinct(), "spare")
    own = with_small(texts, spare, ["node", "place"], "left_anti").select(F.col("node").alias("id"), "text")
    equal = first.where("equal > 1").select(F.col("node").alias("id"))
    if equal.isEmpty():
        return own
    return with_small(own, equal, "id", "left_anti").unionByName(with_small(own, equal, "id", "left_semi").dropDuplicates(["id"]))


def signed(docs: DataFrame) -> DataFrame:
    """A row (key, node) for each signature of each text's set, and one whose key is the node, with the set's size `n` and
    its odd bits: `odd`, and `near`, a few of those of large sets, as the rows of buckets carry them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            sets = shingle_sets(b["text"].tolist())
            ids = b["id"].to_numpy()
            sigs = [signatures(s).astype(np.int64) if len(s) else s.astype(np.int64) for s in sets]
            rest = sum(map(len, sigs))
            n = np.full(len(ids) + rest, -1)
            n[: len(ids)] = [len(s) for s in sets]
            odd = [odd_bits(s) for s in sets]
            near = [folded(x, NEAR) if len(x) > NEAR else None for x in odd]
            yield pd.DataFrame({
                "key": np.concatenate([ids, *sigs]), "node": np.concatenate([ids, np.repeat(ids, [len(x) for x in sigs])]), "n": n,
                "odd": [*odd, *[None] * rest], "near": [*near, *[None] * rest],
            })

    return docs.mapInPandas(run, "key long, node long, n int, odd array<long>, near array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """node and its whole set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"node": b["id"], "items": [s.tobytes() for s in shingle_sets(b["text"].tolist())]})

    return texts.mapInPandas(run, "node long, items binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (a, b) and `same`. They are compared in as many parts as there are pairs to a set, so that the sets in
    motion at any time take about as much room as all sets once."""
    pairs = saved(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = saved(sets_of(with_small(texts, nodes, "id", "left_semi")), "items")
    parts = max(1, -(-pairs.count() // max(1, sets.count())))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    done = [saved(_compared(pairs.where(part("a") == i), sets.where(part("node") == i), sets), "tested") for i in range(parts)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compared(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The pairs and whether they link, by whole sets: those of a in `first`, those of b in `second`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            same = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"], strict=True)]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "same": same})

    x, y = first.select(F.col("node").alias("a"), F.col("items").alias("x")), second.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long, same boolean")


def fitting(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and odd bits allow a link: linked sets differ in at most (|A| + |B|) / 9 elements."""
    of = lambda c: marks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    named = pairs.join(of("a"), "a").join(of("b"), "b").where("5 * na >= 4 * nb AND 5 * nb >= 4 * na")

    def level(x: str, y: str) -> Column:
        """Bits of x, as many as y has: sizes that differ by a quarter give twice as many at most."""
        half = (F.size(x) / 2).cast("int")
        halved = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(y), halved).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(level("oa", "ob"), level("ob", "oa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return named.where(9 * apart <= F.col("na") + F.col("nb")).select("a", "b")


def buckets_of(shared: DataFrame) -> DataFrame:
    """key, node, m (members): one bucket of those with the same members, which two hashes of 64 bits tell."""
    one = shared.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
    return shared.join(one, "key", "left_semi").select("key", "node", "m")


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's centre with its others."""
    use = buckets.groupBy("node").agg(F.sum("m").alias("use"))
    centre = F.max(F.struct("use", "node")).over(W.partitionBy("key"))["node"]
    return buckets.join(use, "node").withColumn("a", centre).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) of all nodes of links (a, b), by rounds of larger and smaller stars."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def rivals(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (`at`, `part`, `label`, `n`, `odd`) in one place, of different labels, whose sizes and odd bits allow
    a link; of rows from two groups of a bucket (`part` differs within a place) only those across."""
    rows = rows.sort_values(["at", "n"], kind="stable")
    at, n, label, part, node, cross = (rows[c].to_numpy() for c in ("at", "n", "label", "part", "node", "cross"))
    words = np.array([len(x) for x in rows["odd"]])
    bits = {}
    for k in np.unique(words):  # each row's bits at its own number of words and, halved, at all smaller ones
        bits[k] = np.zeros((len(rows), k), dtype=np.int64)
    for i, x in enumerate(rows["odd"]):
        x = np.asarray(x, dtype=np.int64)
        for k in bits:
            if k <= len(x):
                bits[k][i] = folded(x, k)
    a, b, live, lag = [], [], np.arange(len(rows)), 0
    while True:
        lag += 1
        live = live[live + lag < len(at)]
        # The rows of a place follow each other by size, so a partner that is too large ends the search of a row.
        live = live[(at[live] == at[live + lag]) & (4 * n[live + lag] <= 5 * n[live])]
        if not len(live):
            return np.concatenate([*a, node[:0]]), np.concatenate([*b, node[:0]])
        here = live[(label[live] != label[live + lag]) & (~cross[live] | (part[live] != part[live + lag]))]
        for k, odd in bits.items():
            fit = here[np.minimum(words[here], words[here + lag]) == k]
            for i in range(0, len(fit), 1 << 14):
                x = fit[i : i + (1 << 14)]
                y = x + lag
                near = 9 * np.bitwise_count((odd[x] ^ odd[y]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                a.append(np.minimum(node[x[near]], node[y[near]]))
                b.append(np.maximum(node[x[near]], node[y[near]]))


def open_pairs(buckets: DataFrame, labels: DataFrame, marks: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of nodes in one bucket, in different components, that may link and have not been compared."""
    at = W.partitionBy("key")
    named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.withColumns({"lo": F.min("label").over(at), "hi": F.max("label").over(at)}).where("lo <> hi").drop("lo", "hi")
    groups = F.ceil(F.col("m") / BLOCK)
    mixed = mixed.withColumn("part", F.pmod(F.xxhash64("node"), groups)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    mixed = mixed.select("node", "label", "part", F.xxhash64("key", lo, hi).alias("at"), (lo < hi).alias("cross"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= ROWS:
                rows = pd.concat(held, ignore_index=True)
                whole = rows["at"] != rows["at"].iloc[-1]  # the last place may go on in the next batch
                if whole.any():
                    a, c = rivals(rows[whole])
                    yield pd.DataFrame({"a": a, "b": c})
                held = [rows[~whole]]
                size = len(held[0])
        if size:
            a, c = rivals(pd.concat(held, ignore_index=True))
            yield pd.DataFrame({"a": a, "b": c})

    placed = mixed.join(marks.select("node", "n", F.coalesce("near", "odd").alias("odd")), "node").repartition("at").sortWithinPartitions("at")
    found = placed.select("at", "part", "cross", "node", "label", "n", "odd").mapInPandas(run, "a long, b long").distinct()
    return found.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def grouped(docs: DataFrame) -> DataFrame:
    """Rows of `near_duplicates`, `same`, by which the rows of an id that stands on several texts are told apart, and
    `stays`: true for the rows of each component's first text that have its smallest id, and for rows without shingles."""
    small_batches(docs.sparkSession)
    texts, ids, first = _named(docs)
    own = _one_of_each(texts, ids, first)
    at = W.partitionBy("key")
    over = {"open": F.min("node").over(at) < F.max("node").over(at), "m": F.count("*").over(at), "x": F.bit_xor("node").over(at), "y": F.bit_xor(F.xxhash64("node")).over(at)}
    found = saved(signed(own).withColumns(over).where("open OR n >= 0").drop("open"), "shared")
    marks = found.where("n >= 0").select("node", F.col("n").cast("long").alias("n"), "odd", "near")
    buckets = saved(buckets_of(found.where("n < 0")), "buckets")
    tested = verified(fitting(stars(buckets), marks), own)
    links = tested.where("same").select("a", "b")
    labels = saved(components(links), "labels")
    more = verified(fitting(open_pairs(buckets, labels, marks, tested), marks), own)
    if not (extra := more.where("same").select("a", "b")).isEmpty():
        labels = saved(components(links.unionByName(extra)), "labels")
    # Nodes are hashes, so the smallest document of a component is that of its nodes' smallest ones; rows without id come last.
    named = saved(first.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    one = named.groupBy("label").agg(best.alias("b")).select("label", F.col("b.least").alias("component"), F.col("b.node").alias("front"))
    named = named.join(one, "label").join(marks.select("node", "n"), "node").select("node", "n", "component", "front")
    out = ids.join(named, "node")
    empty = F.col("n") == 0
    stays = empty | ((F.col("node") == F.col("front")) & F.col("doc_id").eqNullSafe(F.col("component")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "same", stays.alias("stays"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, its own included)."""
    return grouped(docs).drop("same", "stays")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
