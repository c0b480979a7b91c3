"""Document fingerprints by order MinHash: alike where the edit distance is small, not only where the same k-mers occur.

The k-mers of a text, each with the number of its occurrence, are put in order by one hash function for each sketch; the
TUPLE least of them, in the order in which they stand in the text, are hashed together. A fingerprint holds one such hash
of 32 bits, as 8 hex digits, for each sketch; the likeness of two is the share of sketches in which they agree. A k-mer ends
at each code point, those at the start of a text hold a mark of it, so texts of any length are alike by the same rule; the
empty text has the hash of no k-mer. Equal texts have equal fingerprints.

`with_next` compares each row with the next one in ascending doc_id. Rows are dealt by ranges of (doc_id, hash of the text),
whose bounds are rows of the table, so that each range knows which row follows its last: that row is sent to it as well.
Each text is moved once, and no range is held as a whole.

Cases: null is the empty text. Null ids come first; rows with equal ids follow each other by the hash of their text. After
the last row comes the first; a single row is its own next. Columns other than `doc_id` and `text` are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import hash_unit, only, small_batches, table

#: Code points of a k-mer, k-mers of a tuple, hash functions.
K, TUPLE, SKETCHES = 5, 2, 64
#: Stands before the first code point; no code point itself.
BEFORE = 0x110000
#: Bytes of text in a range as a rule, and keys that are looked at to find the bounds of one.
RANGE_BYTES, KEYS_A_RANGE = 32 << 20, 20
#: k-mers that are compared at once, for each hash function.
AT_ONCE = 4096
PAIRS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """Fingerprints of single texts, given as arrays of code points."""

    def __init__(self, k: int = K, size: int = TUPLE, sketches: int = SKETCHES):
        self.k, self.size, self.sketches = k, size, sketches
        draw = np.random.default_rng(13)
        self.add = draw.integers(0, 1 << 32, (sketches, 1), dtype=np.uint32)
        self.mul = draw.integers(0, 1 << 32, (sketches, 1), dtype=np.uint32) | np.uint32(1)

    def kmers(self, points: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the k-mer that ends at each code point."""
        padded, out = np.concatenate([np.full(self.k - 1, BEFORE, dtype=np.uint32), points]), np.zeros(len(points), dtype=np.uint64)
        for j in range(self.k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += padded[j : j + len(out)]
        return _mixed(out)

    def numbered(self, kmers: np.ndarray) -> np.ndarray:
        """32-bit hashes of the k-mers with the number of their occurrence."""
        n = len(kmers)
        low = np.uint64(max(n - 1, 1).bit_length())
        packed = np.sort((kmers >> low << low) | np.arange(n, dtype=np.uint64))
        at, name = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), packed >> low
        first = np.concatenate([[True], name[1:] != name[:-1]])
        since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        seen = np.empty(n, dtype=np.uint64)
        seen[at] = since.astype(np.uint64)
        return (_mixed(kmers + seen * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the least `size` under each hash function, in text order; of equal ones the earliest."""
        best, row, top = None, np.arange(self.sketches), np.uint32(0xFFFFFFFF)
        for lo in range(0, len(hashes), AT_ONCE):
            h = hashes[None, lo : lo + AT_ONCE] ^ self.add
            h *= self.mul
            found = []
            for _ in range(min(self.size, h.shape[1])):
                i = h.argmin(axis=1)
                found.append((h[row, i].astype(np.uint64) << np.uint64(32)) | (i + lo).astype(np.uint64))
                h[row, i] = top
            found = np.stack(found, axis=1)
            best = found if best is None else np.sort(np.concatenate([best, found], axis=1), axis=1)[:, : self.size]
        return np.sort(best & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)

    def fingerprint(self, points: np.ndarray) -> str:
        out = np.zeros(self.sketches, dtype=np.uint64)
        if len(points):
            kmers = self.kmers(points)
            for at in self.least(self.numbered(kmers)).T:
                out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + kmers[at] + np.uint64(1))
        return (out >> np.uint64(32)).astype(">u4").tobytes().hex()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, fingerprint)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sketcher(k, size, sketches)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [s.fingerprint(_points(t)) for t in b["text"]]})

    return only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """The share of sketches in which two fingerprints agree."""
    same = [F.when(F.substr(a, F.lit(8 * i + 1), F.lit(8)) == F.substr(b, F.lit(8 * i + 1), F.lit(8)), 1).otherwise(0) for i in range(sketches)]
    return sum(same[1:], same[0]) / F.lit(float(sketches))


def _ranges(keyed: DataFrame) -> list[tuple]:
    """First keys of the ranges, each that of a row; the first one the least of all."""
    spark, key = keyed.sparkSession, F.struct("given", "id", "h")
    n, size, least = keyed.agg(F.count("*"), F.sum(F.octet_length("text")), F.min(key)).first()
    if not n:
        return []
    wanted = max(-(-(size or 0) // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    draw = hash_unit(F.concat_ws(" ", "id", "h"), "range")
    seen = sorted(tuple(r) for r in keyed.where(draw < min(1.0, KEYS_A_RANGE * wanted / n)).select("given", "id", "h").distinct().collect())
    cuts = [seen[i * len(seen) // wanted] for i in range(1, wanted)] if len(seen) > wanted else seen
    return sorted({tuple(least), *cuts})


def with_next(docs: DataFrame, share: int = 4, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint): in `edited`, the last `share`th part of the
    text's code points is replaced by as many of the next one's first, or by all of them."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("given"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h")
    )
    bounds = _ranges(keyed)
    if not bounds:
        return spark.createDataFrame([], PAIRS)
    sent = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("array<int>")
    def places(given: pd.Series, id: pd.Series, h: pd.Series) -> pd.Series:
        cuts, out = sent.value, []
        for key in zip(given, id, h, strict=True):
            at = bisect_right(cuts, key) - 1
            out.append([at, (at - 1) % len(cuts)] if cuts[at] == key else [at])
        return pd.Series(out)

    dealt = keyed.select("*", F.posexplode(places("given", "id", "h")).alias("after", "place")).select("place", "after", "given", "id", "h", "doc_id", "text")
    dealt = dealt.repartitionById(len(bounds), "place").sortWithinPartitions("after", "given", "id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, before, ended = Sketcher(k, size, sketches), None, False
        for b in batches:
            rows = []
            for doc_id, t, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
                if ended:
                    continue
                ended, points = bool(after), _points(t)
                mine = s.fingerprint(points)
                if before is not None:
                    last_id, last, prints = before
                    cut = len(last) // share
                    edited = np.concatenate([last[: len(last) - cut], points[:cut]])
                    rows.append((last_id, len(last), edited.tobytes().decode("utf-32-le", "replace"), prints, s.fingerprint(edited), mine))
                before = doc_id, points, mine
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema=_ARROW)

    return dealt.select("doc_id", "text", "after").mapInArrow(run, PAIRS)


_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in PAIRS.split(", "))])
_NAMES = _ARROW.names


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = with_next(table(spark, sf_dir, "documents"))
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near)
