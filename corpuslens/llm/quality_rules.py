"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Cases: a null text counts as one without words; it and an empty text fail the base rule. Repeated rows and ties are
rows of their own. Columns other than `doc_id` and `text` are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import only

#: Frequent function words of the languages that the rules are used for.
STOP_WORDS = (
    "the of and to in is that for with as on at it this be by from are was "
    "der die das und ist von den mit zu auf ein eine nicht im für "
    "le la les de des et un une que qui dans en pour pas sur du est au "
    "el los las y del por para con una se no lo su es"
).split()


@dataclass(frozen=True)
class Rule:
    """`low <= measure <= high`; an end that is None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict holds if every rule does.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_word_ratio", 0.01, None),
    Rule("digit_ratio", None, 0.30),
)

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once: a lambda variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    The windows are sorted with their places; a window is repeated if a neighbour in that order is equal.
    """

    def marked(s: Column) -> Column:
        n = F.size(s)
        again = F.filter(
            F.sequence(F.lit(1), n),
            lambda j: ((j > 1) & (F.get(s, j - 2)["w"] == F.get(s, j - 1)["w"])) | ((j < n) & (F.get(s, j)["w"] == F.get(s, j - 1)["w"])),
        )
        at = F.transform(again, lambda j: F.get(s, j - 1)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def windows(w: Column) -> Column:
        tri = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")),
        )
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(F.sort_array(tri), marked))

    return _let(words, windows)


def measures(text: Column) -> dict[str, Column]:
    """The counts that every ratio is made of, as expressions on one text column."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_digits": (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_stop_words": F.size(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.array_contains(stop, x))).cast("long"),
    }


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, the counts, the ratios, `base_failed` and the verdict `kept` of every text."""
    out = only(docs, "doc_id", "text").select("doc_id", *[c.alias(k) for k, c in measures(F.col("text")).items()])
    some = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    out = out.select(
        "*",
        some("word_chars", "n_words").alias("mean_word_chars"),
        some("n_symbols", "word_chars").alias("symbol_ratio"),
        some("n_digits", "word_chars").alias("digit_ratio"),
        some("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        some("n_stop_words", "n_words").alias("stop_word_ratio"),
    )
    holds = F.lit(True)
    for r in rules:
        if r.low is not None:
            holds = holds & (F.col(r.measure) >= r.low)
        if r.high is not None:
            holds = holds & (F.col(r.measure) <= r.high)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & holds)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from corpuslens.llm.common import table

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, doc_id, t,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    len(list_filter(regexp_split_to_array(lower(t), '[^\p{L}]+'), lambda x: list_contains([STOPS], x))) AS stops,
    length(t) - length(translate(t, '0123456789', '')) AS digits
  FROM d
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1
), marked AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY r
), c AS (
  SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(marked.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, stops, digits
  FROM m LEFT JOIN marked USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / word_chars <= 0.10
  AND n_dup_lines / n_lines <= 0.50 AND stops / n_words >= 0.01 AND digits / word_chars <= 0.30 AS kept
FROM f
""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS))
