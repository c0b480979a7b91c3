"""Benchmark decontamination by suffix arrays of the training texts.

The words of a run of training documents form one shard. Its suffixes, cut at WINDOW words as no window is longer, are
sorted; each suffix of a test item is found among them by binary search, and the range found is all its occurrences.
Suffixes that hold a word no item has cannot match and are left out. Items are dealt into blocks of bounded size, of which the
driver holds one. With one block nothing is shuffled. Each further block reads the documents once more and writes the rows it
hits alone, without texts; these are merged by the hash of the text at the end.

Cases: null and empty texts have no words and are clean; items without words match nothing. Rows with one item_id
are one item; one without id hits documents but is not among the items named. Repeated documents are rows of their own.
Texts of any length are searched whole. Empty tables of documents give no rows, empty benchmarks leave all clean. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bpe import MEMO
from corpuslens.llm.common import only, release, saved, small_batches, table, with_small

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
#: Words of one block of items, and of one shard.
BLOCK_WORDS, SHARD_WORDS = 2_000_000, 1_000_000
_FOUND = "doc_id long, key binary, n_words long, spans array<long>, items array<string>, longest long, longest_item string, longest_at long"
_MERGED = ("spans", "items", "longest", "longest_item", "longest_at")


def words_of(text: str) -> list[str]:
    """Words after lower-casing A-Z: letters A-Z count as their lower-case forms."""
    return [w.translate(_LOWER) for w in WORD.findall(text)]


@dataclass
class Block:
    """Distinct windows of some test items: sorted keys, their lengths, and the (item, place) pairs of each."""

    ids: dict[str, int]
    keys: np.ndarray
    tops: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    names: list[str | None]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * WINDOW}").ravel()


def make_block(items: list[tuple[str | None, list[str]]]) -> Block:
    ids: dict[str, int] = {}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(items):
        n = [ids.setdefault(w, len(ids) + 1) for w in words]
        for i in range(max(1, len(n) - WINDOW + 1) if n else 0):
            found.setdefault(tuple(n[i : i + WINDOW]), []).append((k, i))
    windows = sorted(found)
    low = np.zeros((len(windows), WINDOW), dtype=np.int64)
    top = np.full((len(windows), WINDOW), 0xFFFFFFFF, dtype=np.int64)
    for r, w in enumerate(windows):
        low[r, : len(w)] = top[r, : len(w)] = w
    pairs = [p for w in windows for p in found[w]]
    first = np.concatenate([[0], np.cumsum([len(found[w]) for w in windows])]).astype(np.int64)
    return Block(ids, _keys(low), _keys(top), np.array([len(w) for w in windows], dtype=np.int64), first,
                 np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64), [k for k, _ in items])


class _Numbers(dict):
    """Number of a training word in a block, 0 for a word that no item has."""

    def __init__(self, block: Block):
        super().__init__()
        self.ids = block.ids

    def __missing__(self, word: str) -> int:
        got = self.ids.get(word.translate(_LOWER), 0)
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then those of lo[1], and so on."""
    total = int(n.sum())
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total) if total else np.zeros(0, np.int64)


def search(block: Block, docs: list[np.ndarray]) -> list[tuple[list[int], list[str], int, str | None, int]]:
    """For each document (its word numbers): merged hit spans, items, and length, item and place of the longest match."""
    n = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)])  # a 0 after each document
    text = np.zeros(int(starts[-1]) + WINDOW, dtype=np.int64)
    for d, s in zip(docs, starts, strict=False):
        text[s : s + len(d)] = d
    none: list = [([], [], 0, None, -1)] * len(docs)
    if not len(block.sizes):
        return none
    least = int(block.sizes.min())
    zero = np.flatnonzero(text == 0)
    begin = np.flatnonzero(text[: int(starts[-1])])
    begin = begin[zero[np.searchsorted(zero, begin)] - begin >= least]
    rows = text[begin[:, None] + np.arange(WINDOW)]
    rows = np.where(np.cumsum(rows == 0, axis=1) > 0, 0, rows)
    keys = _keys(rows)
    suffixes = np.argsort(keys, kind="stable")
    keys = keys[suffixes]
    lo, hi = np.searchsorted(keys, block.keys, "left"), np.searchsorted(keys, block.tops, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return none
    n_at = (hi - lo)[hit]
    at = begin[suffixes[_ranges(lo[hit], n_at)]]
    window = np.repeat(hit, n_at)
    doc = np.searchsorted(starts, at, "right") - 1
    # Words inside any occurrence.
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.sizes[window], -1)
    covered = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    span_lo, span_hi = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
    # Items of each occurrence, and runs of occurrences along one item: the longest verbatim matches.
    per = (block.first[1:] - block.first[:-1])[window]
    pair = _ranges(block.first[window], per)
    item, place = block.item[pair], block.place[pair]
    p, d = np.repeat(at, per), np.repeat(doc, per)
    size = np.repeat(block.sizes[window], per)
    order = np.lexsort((p, p - place, item, d))
    item, p, d, size, diag = item[order], p[order], d[order], size[order], (p - place)[order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (diag[1:] != diag[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(p))) - 1 + size[head]
    out = list(none)
    bounds = np.searchsorted(d[head], np.arange(len(docs) + 1))
    spans = np.searchsorted(starts, span_lo, "right") - 1
    cuts = np.searchsorted(spans, np.arange(len(docs) + 1))
    for k in np.unique(doc):
        a, b = bounds[k], bounds[k + 1]
        best = a + int(np.argmax(length[a:b]))
        own = slice(cuts[k], cuts[k + 1])
        flat = np.stack([span_lo[own], span_hi[own]], axis=1).ravel() - starts[k]
        names = list(dict.fromkeys(n for i in np.unique(item[head[a:b]]) if (n := block.names[i]) is not None))
        out[k] = (flat.tolist(), names, int(length[best]), block.names[item[head[best]]], int(p[head[best]] - starts[k]))
    return out


def _merged(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of start, end, start, end ..."""
    both = sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)])
    out: list[int] = []
    for lo, hi in both:
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Blocks of at most BLOCK_WORDS words (or one item)."""
    block, held = [], 0
    for r in only(benchmark, "item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((None if r["item_id"] is None else str(r["item_id"]), words))
        held += len(words)
    yield block


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _passes(docs: DataFrame, benchmark: DataFrame) -> list[DataFrame]:
    """Of the first block what it finds in each row, of each further one the rows it hits."""
    small_batches(docs.sparkSession)
    given = only(docs, "doc_id", "text").select("doc_id", _key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    out: list[DataFrame] = []
    for items in blocks_of(benchmark):
        if len(out) == 1:
            out[0] = saved(out[0], "decontamination")
        sent = docs.sparkSession.sparkContext.broadcast(make_block(items))
        found = given.mapInPandas(_pass(sent, not out), _FOUND)
        if out:
            found = saved(found, "decontamination")
            sent.destroy()
        out.append(found)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, `spans` (start, end, ... of hit words), `items`, and the longest verbatim match with its place."""
    first, *more = _passes(docs, benchmark)
    if not more:
        return first.drop("key")
    parts = [d.drop("doc_id", "n_words").withColumn("block", F.lit(k)).dropDuplicates(["key"]) for k, d in enumerate(more)]
    hit = reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", *_MERGED))).alias("more"))  # one of a block
    hit = saved(hit, "decontamination").select("key", *[F.col(f"more.{c}").alias(f"more_{c}") for c in _MERGED])
    return first.join(hit, "key", "left").drop("key").mapInPandas(_fold, _FOUND.replace(" key binary,", ""))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with what the further blocks hit merged in; of equal longest matches, that of the earliest block stays."""
    for b in batches:
        rows = []
        for spans, items, *best, more_spans, more_items, more_n, more_item, more_at in zip(*[b[c] for c in (*_MERGED, *(f"more_{m}" for m in _MERGED))], strict=True):
            spans, items = list(spans), list(items)
            for k in range(0 if more_spans is None else len(more_spans)):
                spans, items = _merged(spans, list(more_spans[k])), [*items, *more_items[k]]
                if more_n[k] > best[0]:
                    best = [more_n[k], more_item[k], more_at[k]]
            rows.append((spans, list(dict.fromkeys(items)), *best))
        found = pd.DataFrame(rows, columns=list(_MERGED), index=b.index)
        yield pd.concat([b[["doc_id", "n_words"]], found], axis=1)


def _pass(sent, whole: bool):
    """Finds a block's items in shards of documents; every row, or with `whole` false the rows that are hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        block = sent.value
        numbers = _Numbers(block)
        held: list[pd.DataFrame] = []
        docs: list[np.ndarray] = []
        size = 0

        def shard() -> pd.DataFrame:
            b = pd.concat(held, ignore_index=True)
            got = search(block, docs)
            b["n_words"] = [len(d) for d in docs]
            for k, c in enumerate(_MERGED):
                b[c] = [g[k] for g in got]
            return b if whole else b[[bool(g[0]) for g in got]]

        for b in batches:
            held.append(b[["doc_id", "key"]])
            for t in b["text"]:
                w = WORD.findall(t)
                docs.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
                size += len(w)
            if size >= SHARD_WORDS:
                yield shard()
                held, docs, size = [], [], 0
        if held:
            yield shard()

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item: each row is decided by its own text, whatever its id."""
    name = "_text"
    while name in docs.columns:
        name += "_"
    hit = reduce(DataFrame.unionAll, [d.where(F.size("spans") > 0).select(F.col("key").alias(name)) for d in _passes(docs, benchmark)])
    return with_small(docs.withColumn(name, _key()), saved(hit, "contaminated"), name, "left_anti").drop(name)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends, starts = F.filter("spans", lambda x, i: i % 2 == 1), F.filter("spans", lambda x, i: i % 2 == 0)
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda e, b: e - b), F.lit(0).cast("long"), lambda n, x: n + x)
    names = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "longest", "longest_at",
    )


def digest(items: list[str]) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()
