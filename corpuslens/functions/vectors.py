"""Hashed text vectors as sparse rows, and dense vector scalars in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.text import token_list, tokenize


def features(text: Column) -> Column:
    """Tokens and pairs of neighbours, in order."""
    t = tokenize(text)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pairs)


def hash_vectors(texts: DataFrame, key: str, text: str = "text", dim: int = 1024) -> DataFrame:
    """(key, bucket, value): L2-normalised sums of signed weights 1 + 0.15 * min(length, 8)."""
    f = texts.select(key, F.explode(features(F.col(text))).alias("g")).withColumn("h", F.md5("g"))
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    weight = 1.0 + 0.15 * F.least(F.length("g"), F.lit(8))
    v = f.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign * weight).alias("v"))
    v = v.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key))))  # at most `dim` rows of each key
    return v.where("norm > 0").select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


#: Texts that are hashed at a time, features of one pass of the digest, and bytes of a feature that fit one block of it.
BATCH_TEXTS, PASS, ONE_BLOCK = 256, 16_384, 55
_SHIFTS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _digests(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 digests of padded blocks, one a column of 16 words."""
    first = [np.full(m.shape[1], x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i, (r, k) in enumerate(zip(_SHIFTS, _ADDED, strict=True)):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += k
        f += m[g]
        turned = f << np.uint32(r)
        turned |= f >> np.uint32(32 - r)
        turned += b
        a, b, c, d = d, turned, b, c
    return a + first[0], b + first[1]


def md5_heads(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch of `raw`, the first 4 bytes of its MD5 digest as a big-endian number, and the 5th byte's last bit."""
    head, bit = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(64), dtype=np.uint8), 64)
    short = np.nonzero(sizes <= ONE_BLOCK)[0]
    for lo in range(0, len(short), PASS):
        at = short[lo : lo + PASS]
        n = sizes[at]
        block = windows[starts[at]] * (np.arange(64) < n[:, None])
        block[np.arange(len(at)), n] = 0x80
        block[:, 56:58] = (8 * n).astype("<u2").view(np.uint8).reshape(-1, 2)
        a, b = _digests(np.ascontiguousarray(block.view("<u4").T))
        head[at], bit[at] = a.byteswap(), b & np.uint32(1)
    for i in np.nonzero(sizes > ONE_BLOCK)[0].tolist():
        h = md5(raw[starts[i] : starts[i] + sizes[i]]).digest()
        head[i], bit[i] = int.from_bytes(h[:4]), h[4] % 2
    return head, bit


def _sums(texts: list[list[str]], dim: int) -> np.ndarray:
    """A row of `dim` sums for each list of tokens: of those and of pairs of neighbours, which are stretches of the tokens put together."""
    words = list(chain.from_iterable(texts))
    if not words:
        return np.zeros((len(texts), dim), dtype=np.float32)
    of, n = np.repeat(np.arange(len(texts)), list(map(len, texts))), np.array(list(map(len, words)))
    ends = np.cumsum(n + 1) - 1
    first = np.nonzero(of[1:] == of[:-1])[0]  # of the pairs
    start, end, row = np.r_[ends - n, (ends - n)[first]], np.r_[ends, ends[first + 1]], np.r_[of, of[first]]
    raw = ("_".join(words) + "_").encode()
    at = np.nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)[0]  # where characters begin
    head, bit = md5_heads(raw, at[start], at[end] - at[start])
    by = (20 + 3 * np.minimum(end - start, 8)) * (1 - 2 * bit)
    return np.bincount(row * dim + head % dim, weights=by, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)


def hashed(texts: DataFrame, key: str, text: str = "text", dim: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, vector): the vectors of `hash_vectors` with all places, times 20 and not scaled to length 1, so that
    every entry is an integer and sums are exact. Nothing is shuffled; a text without tokens has zeros only."""
    import pyarrow as pa

    given = texts.select(key, *keep, F.col(text).alias("_text"))
    kept = [given.schema[c] for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_TEXTS):
                b = whole.slice(lo, BATCH_TEXTS)
                column, dense = b.column("_text"), np.zeros((b.num_rows, dim), dtype=np.float32)
                for at in range(0, b.num_rows, BATCH_TEXTS // 8):  # the features of few texts at a time
                    dense[at : at + BATCH_TEXTS // 8] = _sums([token_list(t) for t in column.slice(at, BATCH_TEXTS // 8).to_pylist()], dim)
                ends = pa.array(np.arange(0, dense.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))], names=[*[f.name for f in kept], "vector"])

    return given.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", vector array<float>")
