"""Token counts: the tokenizer compiled, state by state as needed, into a deterministic finite-state transducer.

A state holds what the rest of a word can depend on: the open beginnings of pieces, the piece before each, and how many
tokens fewer stood there. A transition carries the number of tokens that reading the character adds. A chunk of a text is
a map from the state it is entered in to the state it is left in and a count; because a mark after another character
resets the state, that map needs only the part before the first reset, so maps compose, and long texts are counted chunk
by chunk and joined by a scan over the maps.

A worker keeps a bounded number of states; beyond it, compiling starts anew in mid text, and what goes on is the state's key, so
no count depends on it.

Cases: null and empty texts have no tokens; an empty table gives no rows. Very long texts go chunk by chunk, one without blanks in
one pass. Repeated rows count each. Columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bpe import MARK, MEMO, Pieces, marked, pieces
from corpuslens.llm.common import only, small_batches, table

_RESET = re.compile(f"(?<=[^{MARK}]){MARK}")
CHUNK = 1 << 16
START = (("", None, 0),)


class Transducer:
    """Counts tokens of one word, mark included, by its transitions."""

    def __init__(self, model: Pieces, limit: int = MEMO):
        self.model, self.limit = model, limit
        self._fresh()

    def _fresh(self) -> None:
        # A state: ((open text, piece before it, tokens there less tokens here), ...), longest open text first.
        self.keys: list[tuple] = [START]
        self.number = {START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def at(self, key: tuple) -> int:
        """The number that a state has now; numbers are anew where too many states were compiled."""
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return to

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Next state and tokens added; compiled on first use."""
        got = self.moves[state].get(c)
        return got if got is not None else self._compile(state, c)

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        m, last, added = self.model, c, None
        for text, before, less in self.keys[state]:
            t = text + c
            known = t in m.id
            if (known and m.reachable(t) or not text) and (before is None or m.follows(before, t)):
                last, added = t, less + (1 if known else len(t.encode("utf-8", "replace")))
                break
        if added is None:
            raise AssertionError("a prefix without a last piece")
        opened = [(text + c, before, less - added) for text, before, less in self.keys[state] if text + c in m.prefixes]
        to = self.at((*opened, ("", last, 0)))
        self.moves[state][c] = (to, added)
        return to, added

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """The state that `text` leads to from another, and the tokens it adds; states are named by their keys."""
        state, n, moves = self.at(key), 0, self.moves
        for c in text:
            got = moves[state].get(c)
            if got is None:
                got = self._compile(state, c)
                if len(self.keys) > self.limit:  # also inside a word; the keys go on, the numbers do not
                    now = self.keys[got[0]]
                    self._fresh()
                    got, moves = (self.at(now), got[1]), self.moves
            state = got[0]
            n += got[1]
        return self.keys[state], n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state: read `head`, then, if there was a reset, add `n` and be in `left`, its last character `ends`."""

    head: str
    reset: bool
    n: int
    left: tuple


class Counter(dict):
    """Counts of words met so far; a new word goes through the transducer."""

    def __init__(self, model: Pieces, limit: int = MEMO):
        super().__init__()
        self.machine = Transducer(model, limit)

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.machine.run(START, word)[1]
        if len(word) <= 64:
            self[word] = n
        return n

    def chunk_map(self, chunk: str, before: str) -> ChunkMap:
        """`before`: the character in front of the chunk, which says if its first mark resets."""
        at = [m.start() for m in _RESET.finditer(before + chunk)]
        if not at:
            return ChunkMap(chunk, False, 0, START)
        first, end = at[0] - len(before), at[-1] - len(before)
        whole = sum(map(self.__getitem__, self.machine.model.units.findall(chunk, first, end)))
        left, n = self.machine.run(START, chunk[end:])
        return ChunkMap(chunk[:first], True, whole + n, left)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.reset:
            return ChunkMap(a.head + b.head, b.reset, b.n, b.left)
        state, n = self.machine.run(a.left, b.head)
        return ChunkMap(a.head, True, a.n + n + (b.n if b.reset else 0), b.left if b.reset else state)

    def total(self, text: str, chunk: int = CHUNK) -> int:
        text = marked(text)
        if len(text) <= chunk:
            return sum(map(self.__getitem__, self.machine.model.units.findall(text)))
        maps = [self.chunk_map(text[i : i + chunk], text[i - 1 : i] if i else "") for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # a scan in pairs
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.machine.run(START, maps[0].head)[1] + maps[0].n


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [c.total(t) for t in b["text"]]})

    text = F.coalesce(F.col("text"), F.lit(""))
    given = only(docs, "doc_id", "text").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
