"""Token-ID output: one zstandard frame for each document, all compressed with one shared, trained dictionary.

File format, a Parquet table of shards, in ascending doc_id order by (part, seq): `dict_sha256`, then the index of the
shard (`doc_ids`, `n_tokens`, `offsets`: start of each document's frame in the blob, and the end), then `blob`, the frames
one after another. A frame holds the ids as little-endian unsigned 32-bit integers. One document is read by its offset.

Cases: null and empty texts hold the end id only. Rows with equal doc_id follow each other in the order of their frames;
null ids come first. Columns other than `doc_id` and `text` are ignored. An empty table gives no shards.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.common import hash_unit, held, only, saved, small_batches, table

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
#: Whitespace after another character always begins a new pre-token, as do signs after letters, so texts may be cut there: a word is
#: then known with any sign behind it.
_CUT = re.compile(f"[{_WS}]*+[{_LETTERS}]++(?=[{_SIGNS}])|[{_WS}]*+[^{_WS}]++|[{_WS}]++")
#: Documents and bytes of each that the dictionary is trained on, and its size: bounds of the model fit.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2000, 4096, 64 << 10
DOCS_A_PART, BLOB_BYTES = 4096, 4 << 20
#: Pieces that are encoded as one text, and entries of a worker's memo table.
JOINED, MEMO = 256, 500_000
FRAMES = "doc_id long, part int, n_tokens long, frame binary"
SHARDS = "part int, seq int, dict_sha256 string, tokens long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, blob binary"


_SPACES = {*"\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))}


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "replace")


class Encoder:
    """Ids of whole texts as bytes, from the library's ids of their pieces between cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

        vocab = self.tk.get_vocab()
        #: Bytes that each id stands for: a byte-level piece has a character for each of its bytes.
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new pieces. Those that begin with white space and end with none are encoded many at a time, as one text that
        is cut between them, and told apart by the bytes their ids stand for; a text where that does not come out is not."""
        joined = [w for w in fresh if w[0] in _SPACES and w[-1] not in _SPACES]
        runs = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        whole = ["".join(r) for r in runs]
        for words, text, ids in zip(runs, whole, self._encode(whole), strict=True):
            ends = np.cumsum(list(map(len, words if text.isascii() else map(_bytes, words))))
            total = np.cumsum(self.width[np.frombuffer(ids, dtype=np.uint32)])
            at = np.searchsorted(total, ends)
            if at[-1] == len(total) - 1 and (total[at] == ends).all() and not any(s in text for s in self.special):
                cut = [0, *(4 * (at + 1)).tolist()]
                self.known.update(zip(words, [ids[a:b] for a, b in pairwise(cut)], strict=True))
        rest = [w for w in fresh if w not in self.known]
        self.known.update(zip(rest, self._encode(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_CUT.findall(t) for t in texts]
        every = list(chain.from_iterable(split))
        got = list(map(self.known.get, every))
        lost = [i for i, x in enumerate(got) if x is None]
        fresh = list(dict.fromkeys(map(every.__getitem__, lost)))
        if len(self.known) + len(fresh) > MEMO:  # short pieces, the frequent ones, stay while they are few
            short = {k: v for k, v in self.known.items() if len(k) <= 8}
            self.known = short if len(short) < MEMO // 2 else {}
        self._learn(fresh)
        for i in lost:
            got[i] = self.known[every[i]]
        ends = accumulate(map(len, split), initial=0)
        return [self._encode([t])[0] if any(s in t for s in self.special) else b"".join(got[a:b]) for t, (a, b) in zip(texts, pairwise(ends), strict=True)]


def encoder(path: str) -> Encoder:
    return held(Encoder, path)


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from id arrays of a bounded sample; empty where the sample is too small to train on."""
    import zstandard

    n = docs.count()
    sample = _texts(docs).where(hash_unit("doc_id") < min(1.0, SAMPLE_DOCS / max(n, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [x + array("I", [end_id]).tobytes() for x in encoder(tokenizer).encode(b["text"].tolist())]
            yield pd.DataFrame({"ids": [x[:SAMPLE_BYTES] for x in ids]})

    parts = [bytes(r[0]) for r in sample.mapInPandas(run, "ids binary").sort("ids").limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(raw: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0) -> tuple[DataFrame, bytes]:
    """The table of shards as written, and the dictionary."""
    import zstandard

    spark = docs.sparkSession
    small_batches(spark)
    raw = train_dictionary(docs, tokenizer, end_id)
    digest, end = sha256(raw).hexdigest(), array("I", [end_id]).tobytes()
    n_parts = min(4096, max(1, docs.count() // DOCS_A_PART))
    cuts = only(docs, "doc_id").agg(F.percentile_approx("doc_id", [i / n_parts for i in range(1, n_parts)], 10 * n_parts)).first()[0] if n_parts > 1 else None
    cuts = sorted(set(cuts or []))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3, write_content_size=True, **_dict(raw))
        for b in batches:
            ids = [x + end for x in encoder(tokenizer).encode(b["text"].tolist())]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "part": [0 if d is None or d != d else bisect_right(cuts, d) for d in b["doc_id"]],
                "n_tokens": [len(x) // 4 for x in ids], "frame": [z.compress(x) for x in ids],
            })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, rows, held = None, 0, [], 0

        def shard() -> pd.DataFrame:
            ids, n, fr = zip(*rows, strict=True)
            at = np.concatenate([[0], np.cumsum([len(x) for x in fr])]).astype(np.int64)
            return pd.DataFrame({
                "part": [part], "seq": [seq], "dict_sha256": [digest], "tokens": [sum(n)], "doc_ids": [[None if i is None or i != i else int(i) for i in ids]],
                "n_tokens": [list(n)], "offsets": [at], "blob": [b"".join(fr)],
            })

        for b in batches:
            for p, i, n, f in zip(b["part"], b["doc_id"], b["n_tokens"], b["frame"], strict=True):
                if rows and (p != part or held + len(f) > BLOB_BYTES):
                    yield shard()
                    seq, rows, held = (seq + 1 if p == part else 0), [], 0
                part = p
                rows.append((i, n, f))
                held += len(f)
        if rows:
            yield shard()

    dealt = _texts(docs).mapInPandas(frames, FRAMES).repartition(n_parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "frame")
    return saved(dealt.mapInPandas(pack, SHARDS), "token-shards"), raw


def read_shards(shards: DataFrame, raw: bytes, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, `ids` (their bytes) from the files; of `doc_ids` alone, only those frames are opened."""
    small_batches(shards.sparkSession)
    wanted, digest = set(doc_ids) if doc_ids is not None else None, sha256(raw).hexdigest()
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    at = W.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("tokens").over(at) - F.col("tokens")).alias("inside")).join(before, "part")
    given = shards.join(starts.select("part", "seq", (F.col("before") + F.col("inside")).alias("start")), ["part", "seq"])
    if wanted is not None:
        given = given.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in sorted(wanted)])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdDecompressor(**_dict(raw))
        for b in batches:
            for s in b.itertuples():
                if s.dict_sha256 != digest:
                    raise ValueError("the shard was written with another dictionary")
                start = s.start + np.concatenate([[0], np.cumsum(s.n_tokens)[:-1]])
                keep = [k for k, i in enumerate(s.doc_ids) if wanted is None or i in wanted]
                yield pd.DataFrame({
                    "doc_id": pd.array([None if s.doc_ids[k] is None or s.doc_ids[k] != s.doc_ids[k] else int(s.doc_ids[k]) for k in keep], dtype="Int64"),
                    "start": [int(start[k]) for k in keep], "n_tokens": [int(s.n_tokens[k]) for k in keep],
                    "ids": [z.decompress(s.blob[s.offsets[k] : s.offsets[k + 1]]) for k in keep],
                })

    return given.select("dict_sha256", "start", "doc_ids", "n_tokens", "offsets", "blob").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards, raw = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards, raw).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(array("I", ids).tobytes())
