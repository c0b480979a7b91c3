"""Language ID by word-first backoff.

A known word counts by its log frequency in each language. An unseen one falls back to character n-grams, the longest
order of which the model knows any first, and counts with less weight. The model learns from a bounded sample, dealt evenly
among the languages as far as they have documents, and keeps every word and n-gram of it.

Cases: a null text or one without letters is `und` with score 0. Equal scores go to the language first in order. A null doc_id has a null `held_out`. Rows with
null text, lang or doc_id teach nothing. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bpe import MEMO
from corpuslens.llm.common import hash_unit, held_out, only, small_batches, table

_WORD = re.compile(r"[^\W\d_]+")
#: Bound of the model fit: labelled documents; longest n-gram.
TRAIN_DOCS, ORDER = 20_000, 4
BACKOFF = 0.4


def _words(text: str) -> list[str]:
    """Runs of letters, as `\\p{L}+` finds them: fractions and numerals, which are no digits either, do not count."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


@dataclass
class Model:
    """Words and n-grams, and their log frequencies, a row for each key and a column for each language."""

    langs: list[str]
    words: list[str]
    word_freq: np.ndarray
    grams: list[str]
    gram_freq: np.ndarray


def _log_freq(rows: pa.Table, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys and the smoothed log frequency of each in each language."""
    key, lang = (rows.column(c).combine_chunks().dictionary_encode() for c in ("key", "lang"))
    at = {x: i for i, x in enumerate(langs)}
    col = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)
    n = np.full((len(key.dictionary), len(langs)), 0.5)
    if len(n):
        n[key.indices.to_numpy(), col[lang.indices.to_numpy()]] += rows.column("n").to_numpy()
        n = np.log(n / n.sum(axis=0))
    return key.dictionary.to_pylist(), n.astype(np.float32)


def _even(counts: list[int], total: int) -> float:
    """The number of documents a language may have at most, so that all together have about `total`."""
    left, least = total, 0.0
    for k, n in enumerate(sorted(counts)):
        least = left / (len(counts) - k)
        if n > least:
            return least
        left -= n
    return float(max(counts, default=0))


def sampled(known: DataFrame) -> DataFrame:
    """Documents of each language: all where there are few, else those with the smallest hashes; one at least."""
    place = hash_unit("doc_id")
    seen = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()  # a row for each language
    most = _even([r["n"] for r in seen], TRAIN_DOCS)
    share = known.sparkSession.createDataFrame([(r["lang"], max(min(1.0, most / r["n"]), r["least"] + 1e-12)) for r in seen], "lang string, share double")
    return known.join(F.broadcast(share), "lang").where(place < F.col("share")).drop("share")


def fit(docs: DataFrame) -> Model:
    """Word and n-gram tables of a bounded sample of the labelled documents outside the held-out part."""
    sample = sampled(only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    words = words.groupBy("lang", "key").agg(F.count("*").alias("n")).persist()
    grams = words.select("lang", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("k"), "key").where(F.length("key") >= F.col("k"))
    grams = grams.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - F.col("k") + 1), lambda i: F.col("key").substr(i, F.col("k")))).alias("key"))
    grams = grams.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    w, g = words.toArrow(), grams.toArrow()
    words.unpersist()
    langs = sorted(w.column("lang").unique().to_pylist())
    return Model(langs, *_log_freq(w, langs), *_log_freq(g, langs))


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.grams = {g: i for i, g in enumerate(model.grams)}
        self._fresh()

    def _fresh(self) -> None:
        self.at = {w: i for i, w in enumerate(self.m.words)}
        self.rows = self.m.word_freq

    def backoff(self, word: str) -> np.ndarray:
        for k in range(min(ORDER, len(word)), 0, -1):
            got = [i for i in map(self.grams.get, (word[i : i + k] for i in range(len(word) - k + 1))) if i is not None]
            if got:
                return BACKOFF * self.m.gram_freq[got].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.m.langs))

    def add(self, words: list[str]) -> None:
        """Rows of words that are not known yet; there is room for as many again, so that rows are seldom copied."""
        at = len(self.at)
        if at + len(words) > len(self.rows):
            more = np.zeros((at + 2 * len(words) + MEMO // 8, len(self.m.langs)), np.float32)
            more[:at] = self.rows[:at]
            self.rows = more
        for w in words:
            self.at[w] = at
            self.rows[at] = self.backoff(w)
            at += 1

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        split = list(map(_words, texts))
        if len(self.at) > len(self.m.words) + MEMO:
            self._fresh()
        self.add(list(dict.fromkeys(w for words in split for w in words if w not in self.at)))
        out = []
        for words in split:
            if not words or not self.m.langs:
                out.append(("und", 0.0))
                continue
            s = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            p = np.exp(s - s.max())
            k = int(np.argmax(p))
            out.append((self.m.langs[k], float(p[k] / p.sum())))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text. The model holds keys of a bounded sample only, so it is broadcast."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for b in batches:
            got = scorer.score(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    given = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
