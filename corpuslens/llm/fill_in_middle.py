"""Fill-in-middle transformation: prefix, middle and suffix of each text, put into a new order behind sentinels.

A text is cut at units, `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`. Its bytes lie in blocks of one width; a Fenwick
tree over the blocks holds how many units and code points begin in each. A cut goes down the tree by binary lifting to the
block in which it lies, and is then found inside that block. Texts are read once, row by row; nothing is shuffled.

Cases: null is the empty text. Texts that are empty, hold a sentinel, or are not chosen stay plain, their counts of code points
null. Where both cuts are equal the middle is empty. A null id draws as the empty string does; rows with equal ids draw alike.
Columns other than `doc_id` and `text` are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import only, small_batches, table

#: Bytes of a block.
WIDTH = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Blocks:
    """Unit starts and code points of a UTF-8 text, counted in a Fenwick tree over its blocks."""

    def __init__(self, raw: bytes, width: int = WIDTH):
        given = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACE[given]
        self.raw, self.width = raw, width
        self.starts = np.concatenate([[True], space[1:] & ~space[:-1]])[: len(given)]  # a space after something else begins a unit
        self.points = (given & 0xC0) != 0x80
        self.blocks = -(-len(given) // width)
        self.tree = np.zeros((self.blocks + 1, 2), dtype=np.int64)
        for held, of in enumerate((self.starts, self.points)):
            padded = np.zeros(self.blocks * width, dtype=bool)
            padded[: len(of)] = of
            self.tree[1:, held] = padded.reshape(self.blocks, width).sum(axis=1)
        self.n, self.chars = (int(x) for x in self.tree.sum(axis=0))
        step = 1
        while step <= self.blocks:  # nodes whose lowest bit is `step` are full: they add to the node above
            above = self.tree[2 * step :: 2 * step]
            above += self.tree[step :: 2 * step][: len(above)]
            step *= 2

    def end_of(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first `units` units."""
        if units >= self.n:
            return len(self.raw), self.chars
        block, before, points, step = 0, 0, 0, 1 << max(self.blocks.bit_length() - 1, 0)
        while step:
            if block + step <= self.blocks and before + self.tree[block + step, 0] <= units:
                block += step
                before += int(self.tree[block, 0])
                points += int(self.tree[block, 1])
            step >>= 1
        lo = block * self.width
        at = lo + int(np.flatnonzero(self.starts[lo : lo + self.width])[units - before])
        return at, points + int(self.points[lo:at].sum())


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, suffix_first: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): `share` of 100 texts in a new order, of these `suffix_first` of 100
    with the suffix before the prefix. The draws are those of the seed and the id alone."""
    small_batches(docs.sparkSession)
    marks = p, s, m = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def made(raw: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        t = Blocks(raw, width)
        if not raw or h3 % 100 >= share or any(x in raw for x in marks):
            return t.n, "plain", None, None, raw
        first, second = sorted((h1 % (t.n + 1), h2 % (t.n + 1)))
        (a, a_chars), (b, b_chars) = t.end_of(first), t.end_of(second)
        if h4 % 100 < suffix_first:
            return t.n, "spm", a_chars, b_chars - a_chars, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
        return t.n, "psm", a_chars, b_chars - a_chars, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [made(*r) for r in zip(*(b.column(c).to_pylist() for c in ("raw", "h1", "h2", "h3", "h4")), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    given = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), *_draws(seed))
    return given.mapInArrow(run, MADE)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of `fill_in_middle` was made of: no text that was cut holds a sentinel."""
    parts = F.split(F.substr(output, F.lit(4)), "<[PSM]>")
    one, two, middle = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_H = "('0x' || substr(h, {}, 8))::bigint"
ORACLE = f"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), units AS (
  SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') END AS u FROM given
), drawn AS (
  SELECT *, len(u) AS n, {_H.format(1)} % (len(u) + 1) AS c1, {_H.format(9)} % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= 50 THEN 'plain'
      WHEN {_H.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), cut AS (
  SELECT *, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS p, coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""
