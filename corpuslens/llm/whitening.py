"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Each entry c becomes the integer x = floor(64 c) + 1000000; the fit list holds each distinct x vector once. With Y its rows less
their mean, the steps alternate between t = Y v and z = Y'u, in one pass over the rows each. The left vectors u are as long as
the table and are never stored: each is Y p for a short vector p, so a pass computes them anew from its rows, and with them
what t has of earlier ones; a second pass follows where that is much (full reorthogonalisation). Right vectors are as long as a
row and stay on the driver, orthogonal to all before. Where a direction ends, a new one begins. The steps stop at the row's
length, or as soon as the leading singular triples of the bidiagonal matrix hold to rounding and what is left of the rows'
variance is less than the last of them, so that not even an equal singular value can have been missed.

Rows are binary integers in the shared folder; a pass sends the matrix of the short vectors, at most length x length numbers,
and gets back sums of as many numbers, added up by position in a shuffle.

Cases: rows with a null vector, a null or non-finite entry, or another length than most rows have, are left out; of lengths that
are equally frequent the larger counts. Entries beyond 2^56 count as that. `components` is cut to the number of directions with
a standard deviation above RANK of the largest: equal rows, or one row, give none and no result rows. A `deviation` beyond a
long is null. Rows with equal ids are rows of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import only, saved, table

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
#: Standard deviations below this share of the largest are rounding.
RANK = 1e-11
#: Residual of a singular triple, as a share of the largest singular value, that counts as rounding.
CLOSE = 1e-14
SEED = 11
WHITE = "vec_id long, component int, deviation long, whitened double"


@dataclass
class Centre:
    """Rows of integers less their mean: the mean's nearest integers, and what remains of n times the mean."""

    n: int
    near: np.ndarray  # long
    rest: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the entries, exact."""
        far = x - self.near
        most = int(np.abs(far).max(initial=0)) * self.n + max(map(abs, self.rest))
        if most * most * x.shape[1] < 1 << 63:
            d = far * self.n - np.array(self.rest, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in far]
        return [v if v < 1 << 63 else None for v in exact]


@dataclass
class Whitening:
    centre: Centre
    components: np.ndarray  # length x components
    variances: np.ndarray
    trace: float
    steps: int
    passes: int


def integers(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) with x the integers of a row as little-endian bytes, and the rows' length."""
    given = only(embeddings, key, column).select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    given = given.where((F.size("v") > 0) & F.forall("v", finite))
    length = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = (np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT).astype("<i8")
            ends = np.arange(0, 8 * x.size + 1, 8 * d, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])], names=["vec_id", "x"])

    return given.where(F.size("v") == d).mapInArrow(run, "vec_id long, x binary"), d


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), dtype="<i8").reshape(-1, d)


def _sums(rows: DataFrame, d: int, work: Callable[[np.ndarray], np.ndarray], length: int, kind: str = "double") -> list:
    """What `work` gives for blocks of rows, `length` numbers each, added up; `decimal` for exact sums of longs."""
    given = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype=given)
        for b in batches:
            total += work(_matrix(b.column("x"), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    held = rows.select("x").mapInArrow(run, f"i int, v {'double' if kind == 'double' else 'long'}")
    got = dict(map(tuple, held.groupBy("i").agg(F.sum(F.col("v").cast(kind))).collect()))  # `length` rows
    return [got.get(i, 0) for i in range(length)]


def centre(rows: DataFrame, d: int) -> Centre:
    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)])

    n, both = rows.count(), _sums(rows, d, halves, 2 * d, "decimal(38,0)")
    total = [(int(hi) << 31) + int(lo) for hi, lo in zip(both[:d], both[d:], strict=True)]
    near = [(2 * s + n) // (2 * n) for s in total] if n else [0] * d
    return Centre(n, np.array(near, dtype=np.int64), [s - n * m for s, m in zip(total, near, strict=True)])


def bidiagonalise(rows: DataFrame, d: int, at: Centre, wanted: int) -> Whitening:
    """The `wanted` leading directions of the centred rows."""
    energy = float(_sums(rows, d, lambda x: np.array([np.square(at.centred(x)).sum()]), 1)[0])
    size, passes, draw = np.sqrt(energy), 0, np.random.default_rng(SEED)

    def passed(p: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """With t = Y p: what t has of the left vectors, its square, and Y't."""
        k = left.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            y = at.centred(x)
            t = y @ np.column_stack([p, left])
            return np.concatenate([t.T @ t[:, 0], y.T @ t[:, 0]])

        got = np.array(_sums(rows, d, work, k + 1 + d))
        return got[1 : k + 1], float(got[0]), got[k + 1 :]

    def apart(w: np.ndarray, right: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    right, left, image = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, p and Y'u, a column for each step
    alphas, betas = [], []
    v = draw.standard_normal(d)
    v /= np.linalg.norm(v)
    while True:
        right = np.column_stack([right, v])
        p, before = v, np.inf
        while True:
            of, square, z = passed(p, left)
            passes += 1
            p, z, after = p - left @ of, z - image @ of, square - float(of @ of)
            if after > 0.5 * square or square <= (CLOSE * size) ** 2 or square > 0.5 * before:
                break
            before = square
        alpha = np.sqrt(max(after, 0.0))
        if alpha <= CLOSE * size:
            alpha, p, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, z = p / alpha, z / alpha
        left, image, alphas = np.column_stack([left, p]), np.column_stack([image, z]), [*alphas, alpha]
        k = len(alphas)
        w = apart(z - alpha * v, right) if k < d else np.zeros(d)
        beta = float(np.linalg.norm(w))
        beta = 0.0 if beta <= CLOSE * size else beta
        outer, s, inner = np.linalg.svd(np.diag(alphas) + (np.diag(betas, 1) if betas else 0))
        rest = energy - float(np.square(alphas).sum() + np.square(betas).sum())
        last = s[min(wanted, k) - 1] ** 2
        done = k >= wanted and beta * np.abs(outer[-1, :wanted]).max() <= CLOSE * s[0] and rest < last
        if k == d or energy == 0 or done or rest <= (RANK * size) ** 2:
            break
        betas.append(beta)
        if not beta:
            w = apart(draw.standard_normal(d), right)
        v = w / np.linalg.norm(w)
    c = min(wanted, int((s > RANK * max(s[0], 0.0)).sum())) if energy else 0
    found = right @ inner.T[:, :c]
    found = found / np.linalg.norm(found, axis=0)
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(c)])
    return Whitening(at, found, s[:c] ** 2 / max(at.n, 1), energy / max(at.n, 1), k, passes)


def identity_error(rows: DataFrame, d: int, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    c, by = len(w.variances), w.components / np.sqrt(w.variances)

    def work(x: np.ndarray) -> np.ndarray:
        z = w.centre.centred(x) @ by
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    got = np.array(_sums(rows, d, work, c * c + c))
    mean = got[c * c :] / w.centre.n
    return float(np.abs(got[: c * c].reshape(c, c) / w.centre.n - np.outer(mean, mean) - np.eye(c)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = 16, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), and what it was whitened with."""
    spark = embeddings.sparkSession
    x, d = integers(embeddings, key, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema), None
    rows = saved(x.select("x").distinct(), "whitening-rows")
    at = centre(rows, d)
    w = bidiagonalise(rows, d, at, components)
    c, by = len(w.variances), w.components / np.sqrt(w.variances)
    if not c:
        return spark.createDataFrame([], schema), w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = _matrix(b.column("x"), d)
            each = np.repeat(np.arange(len(held)), c)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(held))), pa.array(at.deviations(held), pa.int64()).take(pa.array(each)), pa.array((at.centred(held) @ by).ravel())],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    shares = F.lit([float(v / w.trace) for v in w.variances])
    out = x.mapInArrow(run, WHITE).withColumns({"n": F.lit(at.n).cast("long"), "explained": F.element_at(shares, F.col("component")), "identity_error": F.lit(identity_error(rows, d, w))})
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"), w


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))[0]
