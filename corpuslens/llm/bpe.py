"""Byte-pair segmentation as a lattice: which adjacent pieces the merge order allows.

A segmentation is the one byte-pair encoding gives exactly if each adjacent pair of pieces, encoded by itself, comes
out as that pair; so every prefix of a word has one last piece, and a left-to-right pass finds it.
"""

from __future__ import annotations

import re
from functools import cached_property

MARK = "▁"
#: Entries of a worker's memo tables; a full table is emptied, which changes no result.
MEMO = 300_000


class Pieces:
    """Vocabulary and merge order of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.pair: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}

    @cached_property
    def prefixes(self) -> set[str]:
        return {p[:i] for p in self.id for i in range(len(p))}

    @cached_property
    def suffixes(self) -> set[str]:
        return {p[i:] for p in self.id for i in range(len(p))}

    @cached_property
    def borders(self) -> tuple[str, str]:
        """Characters that no piece has next to any other than these and marks, and more that no piece has right after a letter."""
        near: dict[str, set[str]] = {c: set() for c in "\n\r\t"}
        for p in self.id:
            near.setdefault(p[0], set())
            for a, b in zip(p, p[1:], strict=False):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        marks = alone = {c for c in near if not re.match(rf"[\w{MARK}]", c)}
        while (kept := {c for c in alone if near[c] <= alone | {MARK}}) != alone:
            alone = kept
        after = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        return "".join(sorted(alone)), "".join(sorted(marks - alone - after))

    @cached_property
    def units(self) -> re.Pattern:
        """Parts of a marked text that no piece crosses: runs of the first kind of borders, and others up to a mark or border."""
        s, d = map(re.escape, self.borders)
        other, letters = rf"(?:[^\w{MARK}{s}]|[\d_])", r"[^\W\d_]*"
        free = rf"{other}*{letters}(?:(?![{d}]){other}+{letters})*" if d else rf"(?:{other}|[^\W\d_])*"
        return re.compile(f"{MARK}+(?:[{s}]+|{free})|[{s}]+|(?=[^{MARK}{s}]){free}")

    @cached_property
    def whole(self) -> set[str]:
        """Pieces that merging their characters gives, and the single characters among them."""
        return {p for p in self.id if self.reachable(p)}

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string by its definition: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        got = self._own.get(piece)
        if got is None:
            got = self._own[piece] = self.merged(piece) == [piece]
        return got

    def follows(self, a: str, b: str) -> bool:
        """Whether piece `b` may stand right after piece `a`."""
        got = self.pair.get((a, b))
        if got is None:
            if len(self.pair) >= MEMO:
                self.pair.clear()
            got = self.pair[a, b] = self.merged(a + b) == [a, b]
        return got

    def ids(self, piece: str) -> list[int]:
        """Ids of one symbol; one outside the vocabulary is written as bytes."""
        got = self.id.get(piece)
        return [got] if got is not None else [self.byte_id[b] for b in piece.encode("utf-8", "replace")]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One copy in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def marked(text: str) -> str:
    """Text as the model sees it: a mark in front and in place of each space."""
    return MARK + text.replace(" ", MARK) if text else ""
