"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two stretches of text is the scaled product of their weighted three-character subsequences, each within a span
of SPAN characters and worth DECAY to the power of the span it takes; inserted characters, blanks among them, only lower the
weight, and subsequences run across words. The machine is fitted on labelled sentences (a sentence has its document's
label), then in rounds on the worst window of each labelled document, as most sentences of a toxic document are clean. A
document's window is found by a machine fitted without that document's fold, so that none is chosen because it was learned;
these machines' values also calibrate the last one, the mean of the rounds' machines of all folds. Nyström features relative to
landmarks make a machine linear, and as a landmark is itself a vector of subsequences, the fitted machine is one weight for
each subsequence. A document's score is that of its worst window of WINDOW characters, calibrated.

Cases: null and empty texts, and those without any letter, digit or sign, score as a window without subsequences. Texts of any
length are scored whole, in blocks that overlap. Blanks between single characters are taken out; combining marks and invisible
characters too. Of equal windows the first counts. Rows without a label teach nothing, several labels of one document count
each, and so do repeated rows. Without labels of both kinds all texts score alike. An empty table gives an empty result.
Columns other than those named are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import hash_unit, held_out, only, release, saved, small_batches, table

SPAN, DECAY, WINDOW = 5, 0.6, 12
#: Bounds of the model fit: labelled documents, sentences of each side, clean windows kept from earlier rounds, landmarks of each side.
TRAIN_DOCS, SENTENCES, CLEAN_WINDOWS, TOXIC_MARKS, CLEAN_MARKS = 20_000, 6_000, 12_000, 192, 64
#: Rounds on worst windows, and folds of the labelled documents.
ROUNDS, FOLDS = 6, 4
SENTENCE = r"[^.!?\n]{1,400}"
_BLANK, _OTHER, CLASSES = 37, 38, 48
_PATTERNS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]
_WORTH = [DECAY ** (b + 1) for _, b in _PATTERNS]
_SCALE = float(np.sqrt(WINDOW * sum(x * x for x in _WORTH)))
_SLICE, _BLOCK = 1 << 20, 1 << 16
_UNKNOWN = 255
_CLASS_OF = np.full(0x110000, _UNKNOWN, dtype=np.uint8)


def class_of(c: str) -> int:
    """1 to 26 for letters without accents, 27 to 36 for digits, ten classes for other letters, one for all else; 0: left out."""
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return 0
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    if "0" <= base <= "9":
        return ord(base) - 21
    return _OTHER + ord(base[:1]) % (CLASSES - _OTHER) if base.isalpha() else _BLANK


def classes(text: str) -> np.ndarray:
    """Classes of the text's characters; a run of blanks and signs is one blank, one between single characters is none; one at both ends."""
    parts = []
    for i in range(0, len(text), _SLICE):
        points = np.frombuffer(text[i : i + _SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = _CLASS_OF[points]
        for p in np.unique(points[got == _UNKNOWN]).tolist():
            _CLASS_OF[p] = class_of(chr(p))
        parts.append(_CLASS_OF[points])
    c = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    c = c[c > 0]
    blank = c == _BLANK
    c = c[~(blank & np.concatenate([[True], blank[:-1]]))] if len(c) else c
    c = c[:-1] if len(c) and c[-1] == _BLANK else c
    edge = np.concatenate([[True], c == _BLANK, [True]])  # edge[i + 1] is of character i
    alone = ~edge[1:-1] & edge[:-2] & edge[2:]
    between = np.zeros(len(c), dtype=bool)
    between[1:-1] = ~alone[1:-1] & edge[2:-2] & alone[:-2] & alone[2:] if len(c) > 2 else False
    return np.pad(c[~between], 1, constant_values=_BLANK) if len(c) else c


def _codes(c: np.ndarray) -> Iterator[np.ndarray]:
    """For each pattern the codes of the subsequences that begin at each place (0: none)."""
    n = len(c)
    x = np.zeros(n + SPAN, dtype=np.int64)
    x[:n] = c
    for a, b in _PATTERNS:
        z = x[b : b + n]
        yield np.where(z > 0, (x[:n] * CLASSES + x[a : a + n]) * CLASSES + z, 0)


def subsequences(stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and weight of each subsequence; a row's weights are scaled as if no subsequence occurred twice."""
    rows, codes, weights = [], [], []
    for i, c in enumerate(stretches):
        code = np.concatenate(list(_codes(c)))
        w = np.where(code > 0, np.repeat(_WORTH, len(c)), 0.0)
        rows.append(np.full(len(code), i))
        codes.append(code)
        weights.append(w / (np.sqrt((w * w).sum()) or 1.0))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


@dataclass
class Model:
    """Weight of each code (of code 0, no subsequence, it is 0), and what makes a margin a probability."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def worst(self, c: np.ndarray) -> tuple[float, int]:
        """The machine's value of the worst window of the classes `c`, and where that window begins."""
        best, place = -np.inf, 0
        for at in range(0, max(1, len(c) - WINDOW + 1), _BLOCK):
            part = c[at : at + _BLOCK + WINDOW + SPAN]
            each = np.zeros(len(part))
            for worth, code in zip(_WORTH, _codes(part), strict=True):
                each += worth * self.weight[code]
            total = np.concatenate([[0.0], np.cumsum(each[: _BLOCK + WINDOW - 1])])
            sums = total[WINDOW:] - total[:-WINDOW] if len(total) > WINDOW else total[-1:]
            j = int(sums.argmax())
            if sums[j] > best:
                best, place = float(sums[j]), at + j
        return best / _SCALE + self.bias, place

    def value(self, text: str | None) -> float:
        return self.worst(classes(text or ""))[0]


def _machine(stretches: list[np.ndarray], toxic: np.ndarray, turn: int) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias: squared-hinge machine on Nyström features, both sides of equal weight; landmarks are dealt by `turn`."""
    if toxic.all() or not toxic.any():
        return np.zeros(CLASSES**3), 1.0 if toxic.any() else -1.0
    deal = np.random.default_rng(turn)
    marks = [i for side, n in ((toxic, TOXIC_MARKS), (~toxic, CLEAN_MARKS)) for i in deal.permutation(np.flatnonzero(side))[:n]]
    row, code, w = subsequences([stretches[i] for i in marks])
    used, at = np.unique(code[code > 0], return_inverse=True)
    if not len(used):
        return np.zeros(CLASSES**3), -1.0
    marked = np.zeros((len(marks), len(used)))
    np.add.at(marked, (row[code > 0], at), w[code > 0])
    val, vec = np.linalg.eigh(marked @ marked.T)
    root = vec / np.sqrt(np.maximum(val, 1e-3)) @ vec.T
    z = np.ones((len(stretches), len(marks) + 1))
    for i in range(0, len(stretches), 500):
        row, code, w = subsequences(stretches[i : i + 500])
        at = np.minimum(np.searchsorted(used, code), len(used) - 1)
        known = used[at] == code
        here = np.zeros((len(stretches[i : i + 500]), len(used)))
        np.add.at(here, (row[known], at[known]), w[known])
        z[i : i + 500, :-1] = here @ marked.T @ root
    y = np.where(toxic, 1.0, -1.0)
    cost = len(y) / 2 / np.where(toxic, toxic.sum(), (~toxic).sum())
    v, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 0.5
    ridge[-1, -1] = 1e-3
    for _ in range(25):  # Newton steps
        on = (y * (z @ v) < 1) * cost
        new = np.linalg.solve((z * on[:, None]).T @ z + ridge, z.T @ (on * y))
        done = np.abs(new - v).max() < 1e-6
        v = new
        if done:
            break
    weight = np.zeros(CLASSES**3)
    weight[used] = marked.T @ (root @ v[:-1])
    return weight, float(v[-1])


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins of labelled documents."""
    z, b = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def _mean(machines: list[tuple[np.ndarray, float]]) -> Model:
    return Model(np.mean([w for w, _ in machines], axis=0), float(np.mean([b for _, b in machines])), 1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and fold of a bounded sample of the labelled documents outside the held-out part."""
    known = only(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.where(hash_unit("doc_id") < min(1.0, TRAIN_DOCS / max(known.count(), 1)))
    known = known.select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.floor(hash_unit("doc_id", "fold") * FOLDS).cast("int").alias("fold"))
    return only(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", "toxic", "fold")  # about TRAIN_DOCS rows


def _worst_windows(train: DataFrame, models: list[Model]) -> pd.DataFrame:
    """toxic, fold, margin and worst window of each document of the sample, by its fold's model; a few bytes each."""
    sent = train.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            folded = [classes(t) for t in b["text"]]
            found = [sent.value[k].worst(c) for c, k in zip(folded, b["fold"].tolist(), strict=True)]
            cut = [c[at : at + WINDOW].tobytes() for c, (_, at) in zip(folded, found, strict=True)]
            yield pd.DataFrame({"toxic": b["toxic"], "fold": b["fold"], "margin": [m for m, _ in found], "cut": cut})

    got = train.mapInPandas(run, "toxic boolean, fold int, margin double, cut binary").toPandas()
    got = got.astype({"toxic": bool}).sort_values(["cut", "margin", "toxic", "fold"], ignore_index=True)
    return got.sample(frac=1, random_state=0, ignore_index=True)  # the same order in every run, whatever the tasks' was


def _machines(stretches: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, turn: int) -> list[tuple[np.ndarray, float]]:
    """A machine without each fold, and one of all."""
    uses = [np.flatnonzero(fold != k) for k in range(FOLDS + 1)]
    return [_machine([stretches[i] for i in use], toxic[use], turn) for use in uses]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    train = saved(labelled(docs, labels), "toxicity-sample")  # the rounds read the sample, not the documents
    every = train.select("fold", "toxic", F.explode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("s")).distinct()
    first = [r for y in (True, False) for r in every.where(F.col("toxic") == y).orderBy(hash_unit("s"), "s", "fold").limit(SENTENCES).collect()]
    toxic, fold = np.array([r["toxic"] for r in first], dtype=bool), np.array([r["fold"] for r in first])
    if toxic.all() or not toxic.any():
        return Model(np.zeros(CLASSES**3), 1.0 if toxic.any() else -1.0, 4.0, -2.0)
    now = _machines([classes(r["s"]) for r in first], toxic, fold, 0)
    rounds: list[list[tuple[np.ndarray, float]]] = []
    clean = None
    for turn in range(1, ROUNDS + 1):
        got = _worst_windows(train, [_mean(m) for m in zip(*rounds, strict=True)] if rounds else [_mean([m]) for m in now])
        clean = pd.concat([clean, got[~got["toxic"]]]).tail(CLEAN_WINDOWS)
        use = pd.concat([got[got["toxic"]], clean])
        rounds.append(_machines([np.frombuffer(x, dtype=np.uint8) for x in use["cut"]], use["toxic"].to_numpy(bool), use["fold"].to_numpy(), turn))
    *others, model = [_mean(m) for m in zip(*rounds, strict=True)]
    got = _worst_windows(train, others)
    model.slope, model.shift = _calibrated(got["margin"].to_numpy(float), got["toxic"].to_numpy(float))
    return model


def margins(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns `keep` and the machine's value of each document's worst window."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    given = only(docs, *keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in given.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield b[list(keep)].assign(margin=[sent.value.value(t) for t in b["text"]])

    return given.mapInPandas(run, f"{schema}, margin double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    p = 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift)))
    return margins(docs, model, "doc_id").select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that the machine does not reject; each row is decided by its own text."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    least = -model.shift / model.slope

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            bad = [sent.value.value(t) >= least for t in b["text"]]
            yield b[~pd.Series(bad, index=b.index, dtype=bool)]

    return docs.mapInPandas(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
