"""Nearest similar vectors of whole tables, for near-duplicate and orphan chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import cosine
from corpuslens.operators.search import _unit, dense_search
from corpuslens.sources.sliced import small, written

#: Rows that are compared in one place at most, twice; rows in a bucket as a rule; partners of a row that are looked at one by one.
BLOCK, BUCKET, CROWD = 2048, 64, 64
#: Chunks of the sketches that are dealt at a time, rows of a block of a crowd, and such blocks that a task holds, twice.
ROUND, MATRIX, PART_BLOCKS = 8, 1024, 8
#: Share of pairs at the least cosine that may be missed.
MISSED = 0.001
#: Bits of a sketch at least: with so many, pairs that share a chunk by chance or are alike by half only differ in too many of them.
SKETCH = 512
SEED = 11


def sketch_size(n: int, least: float) -> tuple[int, int, int, int]:
    """(bits of a chunk, chunks, bits of a sketch, differing bits allowed) so that, of pairs at a cosine of `least`, no more than MISSED
    share no chunk, and as good as none of the others differ in more bits. Chunks grow with the logarithm of the rows, and their
    number with it."""
    off = math.acos(least) / math.pi  # how often a plane parts two such vectors
    bits = min(32, max(8, math.ceil(math.log2(max(n, 2) / BUCKET))))
    tables = max(1, math.ceil(math.log(MISSED) / math.log(1 - (1 - off) ** bits))) if off else 1
    whole = max(SKETCH, bits * tables)
    return bits, tables, whole, math.ceil(whole * off + 5 * math.sqrt(whole * off * (1 - off)))


def _sketches(vectors: DataFrame, bits: int, tables: int, whole: int) -> DataFrame:
    """(id, h: digest of the vector, sketch: a bit for each plane, keys: the chunks' values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(SEED).standard_normal((x.shape[1], whole)).astype(np.float32)
            side = x @ planes > 0
            name = (side[:, : tables * bits].reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2) * tables + np.arange(tables)
            packed = np.packbits(side, axis=1)
            ends = pa.array(np.arange(0, name.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(name.ravel()))], names=["id", "h", "sketch", "keys"]
            )

    return vectors.mapInArrow(run, "id long, h binary, sketch binary, keys array<bigint>")


def _allowed(placed: DataFrame, most: int) -> DataFrame:
    """(a, b, false) pairs in one place whose sketches differ in `most` bits at most; for a row that has more than CROWD of them there,
    (a, null, true) instead, and (b, null, false) for each of those."""

    def pairs(ids: np.ndarray, sketches: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(ids), -1)
        side = np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
        a, b, crowded, beside = [], [], [], np.zeros(len(ids), dtype=bool)
        for lo in range(0, len(ids), 256):
            near = side[lo : lo + 256] @ side.T >= side.shape[1] - 2 * most  # as many bits are equal, less those that differ
            near[np.arange(len(near)), lo + np.arange(len(near))] = False
            many = near.sum(axis=1) > CROWD
            crowded.append(ids[lo : lo + 256][many])
            beside |= near[many].any(axis=0)
            i, j = np.nonzero(near & ~many[:, None])
            a.append(ids[lo + i])
            b.append(ids[j])
        n, marked = sum(map(len, a)), np.concatenate([*crowded, ids[beside]])
        none = pa.nulls(len(marked), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*a, marked])), pa.concat_arrays([pa.array(np.concatenate(b)), none]), pa.array(np.repeat([False, True, False], [n, len(marked) - beside.sum(), beside.sum()]))], names=["a", "b", "crowd"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sketches = None, [], []
        for batch in batches:
            for place, i, s in zip(*(batch.column(c).to_pylist() for c in ("at", "id", "sketch")), strict=True):
                if place != at and len(ids) > 1:
                    yield pairs(np.array(ids, dtype=np.int64), sketches)
                if place != at:
                    at, ids, sketches = place, [], []
                ids.append(i)
                sketches.append(s)
        if len(ids) > 1:
            yield pairs(np.array(ids, dtype=np.int64), sketches)

    return placed.select("at", "id", "sketch").mapInArrow(run, "a long, b long, crowd boolean")


def _candidates(one: DataFrame, tables: int, most: int) -> DataFrame:
    """What `_allowed` finds in the buckets of all chunks of the sketches (id, sketch, keys). ROUND chunks are dealt at a time, so that
    no more than as many copies of the sketches are moved at once, however many chunks there are."""
    found = []
    for lo in range(0, tables, ROUND):
        some = F.explode(F.slice("keys", lo + 1, ROUND)).alias("key")
        # Only the buckets that are dealt in groups are looked up; there are no more of them than rows times chunks by BLOCK. All others stay one group.
        groups = written(one.select(some).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).withColumn("groups", F.ceil(F.col("m") / BLOCK)), "large-buckets")
        named = one.select("id", "sketch", some)
        dealt = named.join(small(groups), "key", "left").withColumn("groups", F.coalesce("groups", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        placed = dealt.select("id", "sketch", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("at")).repartition("at").sortWithinPartitions("at", "id")
        found.append(written(_allowed(placed, most).distinct(), "pairs"))
    return reduce(DataFrame.unionByName, found)


def _of_pairs(few: DataFrame, v: DataFrame, n: int) -> DataFrame:
    """(id, neighbour, cosine) of pairs (a, b), both ways. Vectors travel for about a quarter as many pairs at a time as there are vectors, `n`."""
    pairs = written(few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "few")
    slices = max(1, math.ceil(4 * pairs.count() / max(n, 1)))
    met = []
    for k in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k)
        side = lambda i: v.join(small(some.select(F.col(i).alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias(i), F.col("vector").alias(f"v{i}"))  # noqa: B023, E731
        met.append(written(some.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cosine")), "cosines"))
    both = reduce(DataFrame.unionByName, met)
    return both.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine").unionByName(both.select(F.col("b").alias("id"), F.col("a").alias("neighbour"), "cosine"))


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(first, ids, short, matrix): the rows (id, vector) in blocks of up to MATRIX, each named by its first id. `short`: the matrix is one of
    integers of two bytes, else of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def block() -> pa.RecordBatch:
            x = np.stack(held)
            short = bool((np.abs(x) < 1 << 15).all()) and bool((x == np.rint(x)).all())
            return pa.RecordBatch.from_arrays([pa.array(ids[:1], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([short]), pa.array([x.astype("<i2" if short else "<f4").tobytes()], pa.binary())], names=["first", "ids", "short", "matrix"])

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for i, row in zip(b.column("id").to_pylist(), x, strict=True):
                ids.append(i)
                held.append(row.copy())
                if len(ids) == MATRIX:
                    yield block()
                    ids, held = [], []
        if ids:
            yield block()

    return rows.select("id", "vector").repartition(parts, "id").mapInArrow(run, "first long, ids array<bigint>, short boolean, matrix binary")


def _of_crowd(v: DataFrame, crowd: DataFrame, least: float) -> DataFrame:
    """(id, neighbour, cosine): of each row of the crowd the nearest others in it, by matrix products of blocks, of which each two
    meet once, in one task. A product in single precision says which pairs can be the nearest; their cosines are then exact. Blocks
    are neither joined by key nor copied: a task reads two parts of them, and only the best of each of its rows leave it."""
    n, cores = crowd.count(), v.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(n / (PART_BLOCKS * MATRIX)), math.ceil(math.sqrt(2 * cores)))
    blocks = written(_blocks(v.join(small(crowd), "id", "left_semi"), parts), "crowd-blocks").repartition(parts, "first")
    side = lambda i: blocks.select(*[F.col(c).alias(f"{c}{i}") for c in ("first", "ids", "short", "matrix")])
    met = side(1).crossJoin(side(2)).where("first1 <= first2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}  # ids, cosines and neighbours of the rows of a block
        last: list[tuple] = []  # the block before, with its vectors, their lengths and those of length 1

        def read(b: pa.RecordBatch, r: int, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            first, ids = b.column(f"first{i}")[r].as_py(), b.column(f"ids{i}")[r].values.to_numpy()
            x = np.frombuffer(b.column(f"matrix{i}")[r].as_buffer(), dtype="<i2" if b.column(f"short{i}")[r].as_py() else "<f4").reshape(len(ids), -1).astype(np.float32)
            size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
            if first not in best:
                best[first] = [ids.copy(), np.full(len(ids), -2.0), np.full(len(ids), NONE)]
            return first, best[first][0], x, size, x / size.astype(np.float32)[:, None]

        def take(one: tuple, two: tuple, s: np.ndarray) -> None:
            """Into the best of block `one`, whose rows are those of `s`."""
            _, held, neighbour = best[one[0]]
            slack = (one[2].shape[1] + 8) * 2.0**-23  # no two sums in single precision are further from the true ones
            i, j = np.nonzero(s >= np.maximum(s.max(axis=1), np.maximum(held, least))[:, None] - slack)
            sums = [np.einsum("ij,ij->i", one[2][i[lo : lo + 512]], two[2][j[lo : lo + 512]], dtype=np.float64) for lo in range(0, len(i), 512)]
            c, other = np.round(np.concatenate([*sums, np.zeros(0)]) / one[3][i] / two[3][j], 6), two[1][j]
            order = np.lexsort((other, -c, i))
            i, c, other = i[order], c[order], other[order]
            top = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, dtype=bool)
            i, c, other = i[top], c[top], other[top]
            better = (c >= least) & ((c > held[i]) | (c == held[i]) & (other < neighbour[i]))
            held[i[better]], neighbour[i[better]] = c[better], other[better]

        def meet(b: pa.RecordBatch) -> None:
            for r in range(b.num_rows):
                if not last or last[0][0] != b.column("first1")[r].as_py():
                    last[:] = [read(b, r, 1)]
                one = last[0]
                two = one if b.column("first2")[r].as_py() == one[0] else read(b, r, 2)
                s = one[4] @ two[4].T
                if one is two:
                    np.fill_diagonal(s, -2.0)
                take(one, two, s)
                if one is not two:
                    take(two, one, s.T)

        for b in batches:
            meet(b)
            del b  # before the next one is read
        for ids, c, other in best.values():
            some = c >= least
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(other[some]), pa.array(c[some])], names=["id", "neighbour", "cosine"])

    conf, few = v.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(few)
    conf.set(few, "4")  # two matrices are in each row
    try:
        return written(met.mapInArrow(run, "id long, neighbour long, cosine double"), "crowd-cosines")
    finally:
        conf.set(few, before)


#: Stands for no partner; no key.
NONE = -(1 << 63)


def nearest_similar(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.92) -> DataFrame:
    """(key, neighbour, cosine): the nearest other vector of each, where its cosine is `least` or more; ties go to the smaller key.

    Vectors become sketches, a bit for the side of each random plane. Candidates share a whole chunk of the sketch and differ in
    few bits overall (`sketch_size` says how few, and how surely a pair is found); vectors are fetched for those pairs alone, so
    what travels for all rows are sketches. A bucket of more than BLOCK rows is dealt in groups, and each pair of groups goes to
    one place. Rows with more than CROWD candidates are compared with those in matrix products of blocks instead of pair by pair, so
    that no table holds a crowd's pairs. Equal vectors are compared once. Keys are distinct longs and vectors of one
    length; null vectors, those of length 0 and those that are not finite are like nothing.
    """
    norm = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = written(vectors.where(F.col(column).isNotNull() & (norm > 0) & (norm < float("inf"))).select(F.col(key).alias("id"), F.col(column).cast("array<float>").alias("vector")), "vectors")
    n = v.count()
    bits, tables, whole, most = sketch_size(n, least)
    same = written(_sketches(v, bits, tables, whole), "sketches")
    first = same.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = same.select("id", "h").join(first.where("n > 1"), "h").where("id <> first")
    second = copies.groupBy("first").agg(F.min("id").alias("id"))
    equal = copies.select("id", F.col("first").alias("neighbour")).unionByName(second.select(F.col("first").alias("id"), F.col("id").alias("neighbour"))).withColumn("cosine", F.lit(1.0))
    one = same.join(first.select(F.col("first").alias("id")), "id", "left_semi")
    found = _candidates(one, tables, most)
    pairs = written(found.where("b IS NOT NULL").select("a", "b").distinct(), "all-pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("a")
    crowded = written(found.where("crowd").select("a").unionByName(many).distinct(), "crowded")
    near = _of_pairs(pairs.join(crowded, "a", "left_anti"), v, n)
    if not crowded.isEmpty():
        crowd = crowded.unionByName(found.where("b IS NULL").select("a")).unionByName(pairs.join(crowded, "a", "left_semi").select(F.col("b").alias("a")))
        near = near.unionByName(_of_crowd(v, written(crowd.select(F.col("a").alias("id")).distinct(), "crowd"), least))
    top = F.max(F.struct("cosine", (-F.col("neighbour")).alias("n"))).alias("b")
    best = near.where(F.col("cosine") >= least).unionByName(equal).groupBy("id").agg(top)
    return best.select(F.col("id").alias(key), (-F.col("b.n")).alias("neighbour"), F.col("b.cosine").alias("cosine"))


def near_duplicate_issues(nearest: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each vector whose nearest one has a larger key, so that no pair is told twice."""
    return nearest.where(F.col("neighbour") > F.col(key)).select(key, "neighbour", "cosine", F.lit("duplicate_chunk").alias("issue_type"), F.lit("high").alias("severity"))


def orphans(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.12, refs: int = 4096) -> DataFrame:
    """(key, cosine, issue_type, severity) of vectors whose nearest other vector has a cosine under `least`.

    Each is first compared with `refs` vectors, the same in every run: one like any of those is no orphan. What is left,
    as a rule little, is searched exactly against all rows. Null vectors are left out; one alone, or of length 0, is an orphan.
    """
    v = vectors.where(F.col(column).isNotNull()).select(key, column)
    sample = v.orderBy(F.xxhash64(key), key).limit(refs).collect()  # `refs` rows at most
    ids = np.array([r[key] for r in sample], dtype=np.int64)
    sent = v.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r[column] for r in sample], dtype=np.float64)) if sample else None))

    def lonely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for b in batches:
            if len(b):
                s = np.round(_unit(np.stack(b[column].to_list()).astype(np.float64)) @ q.T, 6)
                s[b[key].to_numpy()[:, None] == ids[None, :]] = -2.0
                yield b[s.max(axis=1) < least]

    left = v.mapInPandas(lonely, v.schema)
    nearest = dense_search(v, left.withColumnRenamed(key, "query_id"), 1, key, column)
    far = left.select(key).join(nearest.select(F.col("query_id").alias(key), "score"), key, "left").withColumn("cosine", F.coalesce("score", F.lit(0.0)))
    return far.where(F.col("cosine") < least).select(key, "cosine", F.lit("orphan_chunk").alias("issue_type"), F.lit("medium").alias("severity"))
