"""Nearest vectors over a stored inverted file: vectors by cell, packed in blocks, with a bound on the cosine for each block.

Centres come from a bounded sample. A vector belongs to the nearest centre's cell; the vectors of one slice and cell lie in
blocks of up to BLOCK_ROWS, one matrix each, with the widest angle to the centre in it. By that angle, no vector of the block
can be closer to a query than a bound says. A search takes the `probes` nearest cells of each query, or, in exact mode, first
those and then every block whose bound reaches the k-th best cosine found, so that nothing is missed.

A block meets all queries that want it in one matrix product; only the k best of each query leave it. Queries travel in groups
of QUERY_ROWS as rows of a table: neither they nor the vectors pass through the driver. Up to SENT_QUERIES are sent to all tasks
instead; a task leaves out blocks by the k-th best cosine it has found itself, so the blocks are read once and not shuffled. Stored slices, versions and changes are
those of `sources.sliced`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.search import top
from corpuslens.sources.sliced import SLICE_DOCS, Sliced, small, written

BLOCK_ROWS, QUERY_ROWS = 256, 256
#: So many queries are sent to all tasks, which then read the blocks once; more travel as rows.
SENT_QUERIES = 4096
#: Vectors that the centres are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 4096, 8
#: Rows that are placed at a time.
PLACED_ROWS = 1024
BLOCKS = "cell int, block int, keys array<bigint>, labels array<string>, norms array<double>, spread double, matrix binary"
CENTRES = "cell int, centre array<double>"
ROWS = "kb_id string, slice int, n_slices int, cell int, key long, label string, norm double, angle double, raw binary"


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def _dense(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _centres(vectors: DataFrame, column: str, cells: int | None) -> np.ndarray:
    """Unit centres by spherical k-means of a sample that is the same in every run; one for 16 sampled vectors by default."""
    drawn = vectors.orderBy(F.xxhash64("kb_id", "key"), "kb_id", "key").limit(SAMPLE).select(column).collect()  # SAMPLE rows at most
    if not drawn:
        return np.zeros((0, 0))
    x = unit(np.array([r[0] for r in drawn], dtype=np.float64))
    c = x[: max(1, min(cells or len(x) // 16, len(x)))]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.linalg.norm(sums, axis=1) > 0
        c = np.where(held[:, None], unit(sums), c)
    return c


def _valid(df: DataFrame, column: str) -> DataFrame:
    """Rows with a vector that has a direction."""
    v = F.col(column)
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (kb_id, slice, n_slices, key, label, vector) with cell, norm, angle to its centre, and the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(lo, PLACED_ROWS) for w in batches for lo in range(0, w.num_rows, PLACED_ROWS)):
            x = _dense(b.column("vector"), b.num_rows)
            norm = np.sqrt((x * x).sum(axis=1))
            s = (x / norm[:, None]) @ centres.T
            cell = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(x)), cell], -1.0, 1.0))
            raw = pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())
            given = {c: b.column(c) for c in ("kb_id", "slice", "n_slices", "key", "label")}
            made = given | {"cell": pa.array(cell.astype(np.int32)), "norm": pa.array(norm), "angle": pa.array(angle), "raw": raw}
            yield pa.RecordBatch.from_pydict({c.split()[0]: made[c.split()[0]] for c in ROWS.split(", ")})

    return rows.select("kb_id", "slice", "n_slices", "key", "label", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, ROWS)


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows that are dealt by slice and sorted by cell and key."""
    schema = f"kb_id string, slice int, {BLOCKS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0

        def block() -> pa.RecordBatch:
            key, label, norm, angle, raw = zip(*held, strict=True)
            kb, part, cell = at
            return pa.RecordBatch.from_pydict({
                "kb_id": pa.array([kb]), "slice": pa.array([part], pa.int32()), "cell": pa.array([cell], pa.int32()), "block": pa.array([n], pa.int32()), "keys": pa.array([list(key)], pa.list_(pa.int64())),
                "labels": pa.array([list(label)], pa.list_(pa.string())), "norms": pa.array([list(norm)], pa.list_(pa.float64())), "spread": pa.array([max(angle)]), "matrix": pa.array([b"".join(raw)], pa.binary()),
            })

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("kb_id", "slice", "cell", "key", "label", "norm", "angle", "raw")]
            for kb, part, cell, *row in zip(*cols, strict=True):
                if held and (at != (kb, part, cell) or len(held) == BLOCK_ROWS):
                    yield block()
                    n, held = (n + 1 if at == (kb, part, cell) else 0), []
                at = kb, part, cell
                held.append(row)
        if held:
            yield block()

    dealt = rows.repartition("kb_id", "slice").sortWithinPartitions("kb_id", "slice", "cell", "key")
    return dealt.mapInArrow(run, schema)


def _unpacked(blocks: DataFrame) -> DataFrame:
    """(kb_id, slice, key, label, vector) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kb, part, keys, labels, m in zip(*(b.column(c).to_pylist() for c in ("kb_id", "slice", "keys", "labels", "matrix")), strict=True):
                x = np.frombuffer(m, dtype="<f4").reshape(len(keys), -1)
                yield pa.RecordBatch.from_pydict({"kb_id": pa.array([kb] * len(keys)), "slice": pa.array([part] * len(keys), pa.int32()), "key": pa.array(keys, pa.int64()), "label": pa.array(labels, pa.string()), "vector": pa.array(list(x), pa.list_(pa.float32()))})

    return blocks.select("kb_id", "slice", "keys", "labels", "matrix").mapInArrow(run, "kb_id string, slice int, key long, label string, vector array<float>")


def _given(vectors: DataFrame, key: str, column: str, label: str | None) -> DataFrame:
    v = _valid(vectors.where("kb_id <> ''"), column)
    return v.select("kb_id", F.col(key).cast("long").alias("key"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.col(column).alias("vector"))


def _stored(table: Sliced, rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Write slices of `rows` (kb_id, slice, n_slices, key, label, vector); their part of the manifest."""
    batch = uuid.uuid4().hex
    table.write("vectors", _packed(_placed(rows, centres)), batch, [])
    return rows.groupBy("kb_id", "slice").agg(F.first("n_slices").alias("n_slices"), F.count("*").alias("n_docs"), F.count("*").alias("total")).withColumn("batch", F.lit(batch))


def build(vectors: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", label: str | None = None, cells: int | None = None, slice_docs: int = SLICE_DOCS) -> Sliced:
    """Store `vectors` (kb_id, key, a vector, a label to filter by) under `path`, a new folder. Vectors are of one length and kept
    as floats; rows without knowledge base, null or empty, or whose vector is null, not finite or of length 0, are left out. Keys are longs."""
    table, spark = Sliced(vectors.sparkSession, path), vectors.sparkSession
    v = written(_given(vectors, key, column, label), "given-vectors")  # made once: vectors of texts are dear
    centres = _centres(v, "vector", cells)
    empty = spark.createDataFrame([], "kb_id string, n_slices int")
    kept = _stored(table, table.dealt(v, empty, "key", slice_docs), centres)
    table.commit(kept, centres=_told(spark, centres))
    return table


def _told(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], CENTRES)


def change(table: Sliced, rows: DataFrame | None = None, remove: DataFrame | None = None, key: str = "vec_id", column: str = "embedding", label: str | None = None, order: str | None = None, slice_docs: int = SLICE_DOCS) -> Sliced:
    """Put `rows` in place of those with their knowledge base and key, and take away `remove` (kb_id, key); centres stay. Only slices
    that hold such keys are written anew. Of `rows` with equal keys the one with the largest `order`, then vector, stays."""
    held, spark = table.manifest(), table.spark
    centres = np.array([c for _, c in sorted(map(tuple, table.beside("centres", CENTRES).collect()))])  # a row for each cell
    none = spark.createDataFrame([], f"kb_id string, {key} long, {column} array<float>")
    given = rows if rows is not None else none
    rank = F.struct(*([F.col(order)] if order else []), F.col(column).cast("array<float>").alias("v"), *([F.col(label)] if label else []))
    last = given.groupBy("kb_id", key).agg(F.max(rank).alias("r")).select("kb_id", key, F.col("r.v").alias(column), *([F.col(f"r.{label}").alias(label)] if label else []))
    named = table.dealt(last.where("kb_id <> ''").withColumn("key", F.col(key).cast("long")), held, "key", slice_docs)
    gone = named.select("kb_id", "slice", "key")
    if remove is not None:
        r = remove.where("kb_id <> ''").select("kb_id", F.col(key).cast("long").alias("key")).join(small(held.select("kb_id", "n_slices").distinct()), "kb_id")
        gone = gone.unionByName(r.withColumn("slice", F.pmod(F.xxhash64("key"), F.col("n_slices")).cast("int")).select("kb_id", "slice", "key")).distinct()
    touched = gone.select("kb_id", "slice").distinct()
    stay = _unpacked(table.rows("vectors", BLOCKS, held.join(touched, ["kb_id", "slice"], "left_semi"))).join(gone, ["kb_id", "slice", "key"], "left_anti")
    stay = stay.join(small(held.select("kb_id", "slice", "n_slices")), ["kb_id", "slice"])
    fresh = table.dealt(_given(last, key, column, label), held, "key", slice_docs)
    if not centres.size:  # the index was empty until now
        centres = _centres(_given(last, key, column, label), "vector", None)
    cols = ["kb_id", "slice", "n_slices", "key", "label", "vector"]
    kept = _stored(table, stay.select(*cols).unionByName(fresh.select(*cols[:-1], F.col("vector").cast("array<float>").alias("vector"))), centres)
    table.commit(held.join(touched, ["kb_id", "slice"], "left_anti").unionByName(kept.select(*held.columns)), centres=_told(spark, centres))
    return table


def search(table: Sliced, queries: DataFrame, k: int | str = 10, key: str = "vec_id", column: str = "vector", probes: int | None = None, scope: DataFrame | None = None, filters: DataFrame | None = None, label: str = "domain", others: bool = False, first: int = 2, least: float | None = None) -> DataFrame:
    """(query_id, key, kb_id, score, rank): the k nearest vectors, by cosine rounded to 6 places, of each query (query_id, a vector);
    ties go to the smaller key. `k` may name a column of the queries, `others` leaves out the vector whose key is the query's id.

    With `probes`, the vectors of so many cells are looked at; without, all that can be among the k best. `scope` (query_id,
    kb_id) names what a query may see: without a row it finds nothing. `filters` (query_id, label) names what labels a query
    that has a row there may find. Below a cosine of `least` nothing is found, nor looked for.
    """
    spark = table.spark
    cells = sorted(map(tuple, table.beside("centres", CENTRES).collect()))  # a row for each cell
    if not cells:
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, `{key}` long, kb_id string, score double, rank int")
    centres = np.array([c for _, c in cells])
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    q = _valid(queries, column).select("query_id", limit.cast("int").alias("k"), F.col(column).cast("array<double>").alias("v"))
    if filters is not None:
        told = filters.groupBy("query_id").agg(F.array_sort(F.collect_set(label)).alias("labels"))  # labels of one query
        q = q.join(told, "query_id", "left")
    else:
        q = q.withColumn("labels", F.lit(None).cast("array<string>"))
    kind = q.schema["query_id"].dataType.simpleString()
    q = written(q, "asked-vectors")
    count = q.count()
    if count <= SENT_QUERIES:
        found = _met(table, q, centres, kind, probes, scope, others, least)
        return top(found, "query_id", "score", "key", F.col("k")).select("query_id", F.col("key").alias(key), "kb_id", "score", "rank")
    groups = -(-count // QUERY_ROWS)
    q = q.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.arccos(np.clip(unit(_dense(b.column("v"), b.num_rows)) @ centres.T, -1.0, 1.0))
            place = s.argsort(axis=1, kind="stable").argsort(axis=1)
            n, m = s.shape
            each = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(each), b.column("g").take(each), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(s.ravel()), pa.array(place.ravel().astype(np.int32))], names=["query_id", "g", "cell", "angle", "place"])

    near = q.select("query_id", "g", "v").mapInArrow(angles, f"query_id {kind}, g int, cell int, angle double, place int")
    seen = table.manifest(None if scope is None else scope)
    blocks = table.rows("vectors", BLOCKS, seen)
    pairs = blocks.select("kb_id", "slice", "cell", "block", "spread").join(near if probes is None else near.where(F.col("place") < probes), "cell")
    if scope is not None:
        pairs = pairs.join(scope.select("query_id", "kb_id").distinct(), ["query_id", "kb_id"], "left_semi")
    pairs = written(pairs, "block-pairs")
    packs = q.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("query_id", "k", "labels", "v"))).alias("pack"))  # about QUERY_ROWS queries
    packs = packs.select("g", *[F.col(f"pack.{c}").alias(f"q_{c}") for c in ("query_id", "k", "labels")], F.flatten("pack.v").alias("q_v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r] for c in b.schema.names}
                keys, ids, ks = np.asarray(one["keys"].values), one["q_query_id"].values, np.asarray(one["q_k"].values)
                wanted = set(one["asked"].as_py())
                pick = np.array([i for i, x in enumerate(ids.to_pylist()) if x in wanted])
                x = np.frombuffer(one["matrix"].as_py(), dtype="<f4").reshape(len(keys), -1).astype(np.float64)
                v = np.asarray(one["q_v"].values).reshape(len(ids), -1)[pick]
                s = np.round((v @ x.T) / np.sqrt((v * v).sum(axis=1))[:, None] / np.asarray(one["norms"].values)[None, :], 6)
                fits = np.ones(s.shape, dtype=bool)
                labels = one["labels"].as_py()
                for i, p in enumerate(pick):
                    let = one["q_labels"].values[int(p)].as_py()
                    if let is not None:
                        fits[i] = [x in let for x in labels]
                if others:
                    fits &= np.array(ids.take(pa.array(pick)).to_pylist(), dtype=object)[:, None] != keys[None, :]
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)
                at = np.take_along_axis(fits, order, axis=1)
                i, j = np.nonzero(at & (np.cumsum(at, axis=1) <= ks[pick][:, None]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pick[i])), pa.array(ks[pick[i]].astype(np.int32)), pa.array([one["kb_id"].as_py()] * len(i), pa.string()), pa.array(keys[order[i, j]]), pa.array(s[i, order[i, j]])], names=["query_id", "k", "kb_id", "key", "score"])

    def scored(some: DataFrame) -> DataFrame:
        asked = some.groupBy("kb_id", "slice", "cell", "block", "g").agg(F.collect_list("query_id").alias("asked"))  # of one group of queries
        met = blocks.join(asked, ["kb_id", "slice", "cell", "block"]).join(packs, "g")
        found = met.select("kb_id", "keys", "labels", "norms", "matrix", "asked", "q_query_id", "q_k", "q_labels", "q_v").mapInArrow(best, f"query_id {kind}, k int, kb_id string, key long, score double")
        return top(found if least is None else found.where(F.col("score") >= least), "query_id", "score", "key", F.col("k"))

    if probes is None:
        kth = scored(pairs.where(F.col("place") < first)).where("rank = k").select("query_id", F.col("score").alias("kth"))
        bound = F.cos(F.greatest(F.col("angle") - F.col("spread"), F.lit(0.0)))
        pairs = pairs.join(written(kth, "kth-cosines"), "query_id", "left").where((F.col("place") < first) | (bound >= F.coalesce(F.greatest(F.col("kth"), F.lit(least).cast("double")), F.lit(-1.0)) - 0.000002))
    return scored(pairs).select("query_id", F.col("key").alias(key), "kb_id", "score", "rank")


def _met(table: Sliced, queries: DataFrame, centres: np.ndarray, kind: str, probes: int | None, scope: DataFrame | None, others: bool, least: float | None) -> DataFrame:
    """(query_id, k, kb_id, key, score): each task's k nearest of a bounded number of queries (query_id, k, v, labels)."""
    spark, given = table.spark, queries.orderBy("query_id").collect()  # SENT_QUERIES at most
    ids, ks = [r["query_id"] for r in given], np.array([r["k"] for r in given], dtype=np.int64)
    v = unit(np.array([r["v"] for r in given], dtype=np.float64)) if given else np.zeros((0, centres.shape[1]))
    lets = {i: set(r["labels"]) for i, r in enumerate(given) if r["labels"] is not None}
    at, sees = {x: i for i, x in enumerate(ids)}, None
    if scope is not None:  # of these queries
        sees = {r["kb_id"]: np.array([at[x] for x in r["q"]], dtype=np.int64) for r in scope.join(small(queries.select("query_id")), "query_id", "left_semi").groupBy("kb_id").agg(F.collect_set("query_id").alias("q")).toLocalIterator()}
    blocks = table.rows("vectors", BLOCKS, table.manifest(scope)).select("kb_id", "cell", "keys", "labels", "norms", "spread", "matrix")
    sent = spark.sparkContext.broadcast((ids, ks, v, lets, sees, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ks, v, lets, sees, centres = sent.value
        if not ids:
            return
        angle = np.arccos(np.clip(v @ centres.T, -1.0, 1.0))
        place = angle.argsort(axis=1, kind="stable").argsort(axis=1)
        kth = np.full(len(ids), -1.0 if least is None else least)
        own = np.array(ids, dtype=object)
        kbs: list[str] = []
        kept, more, waits = None, [[], [], [], []], 0

        def best(cols: list[np.ndarray]) -> list[np.ndarray]:
            q, s, key, _ = cols
            order = np.lexsort((key, -s, q))
            cols = [c[order] for c in cols]
            q, s = cols[0], cols[1]
            rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q]
            last = rank == ks[q] - 1
            kth[q[last]] = s[last]
            return [c[rank < ks[q]] for c in cols]

        for b in batches:
            for r in range(b.num_rows):
                kb, cell = b.column("kb_id")[r].as_py(), b.column("cell")[r].as_py()
                wanted = place[:, cell] < probes if probes is not None else np.cos(np.maximum(angle[:, cell] - b.column("spread")[r].as_py(), 0.0)) >= kth - 0.000002
                if sees is not None:
                    seen = np.zeros(len(ids), dtype=bool)
                    seen[sees.get(kb, [])] = True
                    wanted &= seen
                pick = np.nonzero(wanted)[0]
                if not len(pick):
                    continue
                keys = b.column("keys")[r].values.to_numpy()
                x = np.frombuffer(b.column("matrix")[r].as_buffer(), dtype="<f4").reshape(len(keys), -1).astype(np.float64)
                s = np.round((v[pick] @ x.T) / b.column("norms")[r].values.to_numpy()[None, :], 6)
                fits = s >= kth[pick][:, None]
                if lets:
                    labels = b.column("labels")[r].as_py()
                    for i, p in enumerate(pick.tolist()):
                        if p in lets:
                            fits[i] &= [y in lets[p] for y in labels]
                if others:
                    fits &= own[pick][:, None] != keys[None, :]
                i, j = np.nonzero(fits)
                if not kbs or kbs[-1] != kb:
                    kbs.append(kb)
                for held, y in zip(more, (pick[i], s[i, j], keys[j], np.full(len(i), len(kbs) - 1)), strict=True):
                    held.append(y)
                waits += len(i)
                if kept is None or waits > 100_000:
                    kept, more, waits = best([np.concatenate([*([kept[c]] if kept else []), *more[c]]) for c in range(4)]), [[], [], [], []], 0
        if kept is None:
            return
        q, s, key, kb = best([np.concatenate([kept[c], *more[c]]) for c in range(4)])
        yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(ks[q].astype(np.int32)), pa.array(kbs, pa.string()).take(pa.array(kb)), pa.array(key), pa.array(s)], names=["query_id", "k", "kb_id", "key", "score"])

    return blocks.mapInArrow(run, f"query_id {kind}, k int, kb_id string, key long, score double")
