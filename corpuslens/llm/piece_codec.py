"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut where no piece can cross. The distinct marked words so got of a batch are sorted, which is the depth-first order of their trie; the forward table of a word
is kept up to what it shares with the next one. `kind="unigram"` adds piece scores and keeps the best path to each
prefix; `kind="bpe"` keeps the one path whose neighbours the merge order allows, which is what a byte-pair model encodes.

Cases: null and empty texts have no ids and decode to the empty text. A mark character in a text decodes as a space, as in
the library. Repeated rows are rows of their own. Columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bpe import MARK, Pieces, marked
from corpuslens.llm.common import held, only, small_batches, table

_NO = float("-inf")
#: Entries of a worker's tables of whole words and of parts of words, and of pairs of pieces.
WORDS, MEMO = 500_000, 150_000
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class Viterbi:
    def __init__(self, model: Pieces, kind: str = "bpe"):
        self.model, self.kind = model, kind
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.code: dict[str, bytes] = {}
        self._fresh()

    def _fresh(self) -> None:
        """For each piece that merging gives, the pieces it may follow or not, as found so far; None for other ends of pieces."""
        m, self.pairs = self.model, 0
        self.after: dict[str, dict[str, bool] | None] = dict.fromkeys(m.suffixes) | {p: {} for p in m.whole} if self.kind == "bpe" else {}

    def _allowed(self, word: str, n: int, last: list) -> None:
        """Last pieces of word[:i] for i > n, from the entries before them: the shortest one that the merge order allows."""
        if self.pairs >= MEMO:
            self._fresh()
        after, merged = self.after, self.model.merged
        for i in range(n + 1, len(word) + 1):
            for j in range(i - 1, 0, -1):
                t = word[j:i]
                try:
                    may = after[t]
                except KeyError:
                    if j < i - 1:
                        raise AssertionError("a prefix without a last piece") from None
                    may = {}  # a character outside the vocabulary
                if may is None:
                    if j < i - 1:
                        continue
                    may = {}
                p = last[j]
                ok = may.get(p)
                if ok is None:
                    ok = may[p] = merged(p + t) == [p, t]
                    self.pairs += 1
                if ok:
                    break
            else:
                t = word[:i]
            last.append(t)

    def _best(self, word: str, n: int, last: list, score: list) -> None:
        """Best last pieces of word[:i] for i > n by the sum of scores; shorter pieces are tried first."""
        m = self.model
        for i in range(n + 1, len(word) + 1):
            best, piece = _NO, word[i - 1]
            for j in range(i - 1, -1, -1):
                t = word[j:i]
                if j < i - 1 and t not in m.suffixes:
                    break
                if j < i - 1 and t not in m.id:
                    continue
                s = score[j] + m.score.get(t, -1e6)
                if s > best:
                    best, piece = s, t
            last.append(piece)
            score.append(best)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as bytes of 32-bit integers."""
        out, m, code = {}, self.model, self.code
        last: list = [None]
        score: list = [0.0]
        prev = ""
        for w in sorted(set(words)):
            n = 0
            for a, b in zip(prev, w, strict=False):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], score[n + 1 :]
            if self.kind == "bpe":
                self._allowed(w, n, last)
            else:
                self._best(w, n, last, score)
            path: list[bytes] = []
            i = len(w)
            while i:
                p = last[i]
                if (ids := code.get(p)) is None:
                    if len(code) >= MEMO:
                        code.clear()
                    ids = code[p] = array("i", m.ids(p)).tobytes()
                path.append(ids)
                i -= len(p)
            path.reverse()
            out[w] = b"".join(path)
            prev = w
        return out

    def _learn(self, words: list[str]) -> None:
        """Learn words, whole if they are all letters, else from their parts that no piece crosses."""
        units = self.model.units
        letters = [w for w in words if w.isalpha()]
        split = [(w, units.findall(MARK + w)) for w in words if not w.isalpha()]
        fresh = set(chain.from_iterable(u for _, u in split)).difference(self.known)
        if len(self.known) + len(fresh) > MEMO:
            self.known = _short(self.known, MEMO)
            fresh = set(chain.from_iterable(u for _, u in split)).difference(self.known)
        for u in [u for u in fresh if u[0] == MARK and u[1:] in self.words]:
            self.known[u] = self.words[u[1:]]
            fresh.discard(u)
        got = self.encode_words(fresh.union([MARK + w for w in letters]))
        self.words.update((w, got[MARK + w]) for w in letters)
        self.known.update((u, got[u]) for u in fresh)
        get = self.known.__getitem__
        self.words.update((w, b"".join(map(get, u))) for w, u in split)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_words(t) for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.words)
        if len(self.words) + len(fresh) > WORDS:
            self.words = _short(self.words, WORDS)
            fresh = set(chain.from_iterable(split)).difference(self.words)
        self._learn(list(fresh))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.int32) for words in split]


def _short(memo: dict[str, bytes], most: int) -> dict[str, bytes]:
    """A full table's short words, the frequent ones, while they are few."""
    short = {k: v for k, v in memo.items() if len(k) <= 8}
    return short if len(short) < most // 2 else {}


def _words(text: str) -> list[str]:
    """What follows each mark of the marked text; of several marks in a row, what follows the first."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _MARKED.findall(marked(text))]


class Decoder:
    def __init__(self, model: Pieces):
        known = {i: p.replace(MARK, " ").encode() for p, i in model.id.items()} | {i: bytes([b]) for b, i in enumerate(model.byte_id)}
        self.piece = np.array([known.get(i, b"") for i in range(max(known) + 1)], dtype=object)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.piece[ids].tolist()).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _codec(path: str, kind: str) -> tuple[Viterbi, Decoder]:
    model = Pieces(path)
    return Viterbi(model, kind), Decoder(model)


def codec(path: str, kind: str = "bpe") -> tuple[Viterbi, Decoder]:
    return held(_codec, path, kind)


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """doc_id and `ids` of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, _ = codec(model, kind)
        for b in batches:
            ids = enc.encode(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids})

    given = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and `text` from doc_id and `ids`."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, dec = codec(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [dec.decode(x) if x is not None else "" for x in b["ids"]]})

    return only(encoded, "doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text again (a mark character reads as a space)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, dec = codec(model, kind)
        for b in batches:
            texts = b["text"].tolist()
            ids = enc.encode(texts)
            same = [dec.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_ids": [len(x) for x in ids], "ids": ids, "round_trip": same})

    given = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_checked(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
