"""Text scalars as Column expressions; null counts as the empty text unless said otherwise."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, stop words, standard-code and clause patterns, mandatory words.
TOKEN = r"[一-龥]+|[a-zA-Z][a-zA-Z\-]*|\d+(?:\.\d+)*"
STOP_WORDS = (
    "的 了 和 是 在 有 与 及 或 对 为 上 下 中 我 你 他 它 这 那 什么 怎么 如何 请问 一下 可以 需要 应该 以及 等等 一个 进行 通过 由于 关于 "
    "the a an of to is are in on for and or"
).split()
STANDARD_CODE = r"(?i)(?<![A-Za-z0-9])((?:GB/T|GBT|GB|JGJ|JG|JTG|JTS|CJJ|CECS|DL|SL|TB|YB|DB\d{2}(?:/T)?|Q/[A-Z0-9]+)\s*/?\s*T?\s*\d{1,5}(?:\.\d+)?\s*[-—]\s*\d{4})(?![0-9])"
CLAUSE = r"^(?:第)?(\d{1,2}(?:\.\d{1,3}){1,3})\s*(?:条)?"
MANDATORY = ("必须", "严禁", "不得", "禁止")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokenize(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens in order, without stop words and single characters that are not CJK."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    every = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))
    return F.filter(every, lambda x: ~F.array_contains(stop, x) & ((F.length(x) > 1) | x.rlike(r"[一-龥]")))


_TOKEN, _STOP = re.compile(TOKEN, re.ASCII), frozenset(STOP_WORDS)


def token_list(text: str | None) -> list[str]:
    """What `tokenize` gives, for texts that are in a task of Python already. No token holds white space, nor a NUL; only ASCII and
    CJK characters are in tokens, so they can be lower-cased together."""
    every = "\0".join(_TOKEN.findall(text or "")).lower().split("\0")
    return [w for w in every if (len(w) > 1 or "一" <= w <= "龥") and w not in _STOP]


def token_counts(text: str | None) -> dict[str, int]:
    """Distinct tokens of `token_list` and how often each occurs."""
    return Counter(token_list(text))


def clean_text(c: Column) -> Column:
    """Plain blanks, at most one blank line, no page-number lines, trimmed."""
    t = F.translate(text_or_empty(c), " 　", "  ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?m)^\s*[-—]{0,2}\s*\d{1,4}\s*[-—]{0,2}\s*$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(text_or_empty(c), 256)


def standard_code(c: Column) -> Column:
    """First standard code, upper case, plain dash; empty if none."""
    code = F.translate(F.upper(F.regexp_extract(text_or_empty(c), STANDARD_CODE, 1)), "—", "-")
    return F.regexp_replace(F.regexp_replace(code, r"\s+", " "), r"\s*-\s*", "-")


def standard_codes(c: Column) -> Column:
    """All codes of a query without white space."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(STANDARD_CODE), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))


def clause_no(c: Column) -> Column:
    """Dotted clause number that the first 60 characters begin with; empty if none."""
    return F.regexp_extract(F.trim(F.substring(text_or_empty(c), 1, 60)), CLAUSE, 1)


def is_mandatory(c: Column, words: tuple[str, ...] = MANDATORY) -> Column:
    return F.substring(text_or_empty(c), 1, 150).rlike("|".join(words))


def truncate_to(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def summary(c: Column, limit: int = 200) -> Column:
    """Whole sentences up to `limit` characters, or the first `limit` if the first sentence is longer."""
    zero = F.struct(F.lit("").alias("buf"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | (F.length(acc["buf"]) + F.length(s) > limit)
        return F.struct(F.when(full, acc["buf"]).otherwise(F.concat(acc["buf"], s)).alias("buf"), full.alias("full"))

    def short(t: Column) -> Column:
        head = F.substring(t, 1, limit + 1)  # sentences that end later don't fit
        return _let(F.aggregate(F.split(head, r"(?<=[。！？!?\n])"), zero, step, lambda a: a["buf"]), lambda buf: F.when(buf != "", buf).otherwise(F.substring(t, 1, limit)))

    return _let(clean_text(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(short(t), r"^\s+|\s+$", ""), F.lit("…"))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_section(path: Column, text: Column) -> Column:
    """Section path in front, unless the text begins with its last title."""
    last = F.element_at(F.split(path, " > "), -1)
    return F.when(blank(path) | text.startswith(last), text).otherwise(F.concat(F.lit("【"), path, F.lit("】\n"), text))


def citation_marks(c: Column) -> Column:
    """Distinct numbers of marks like [2]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))


def phrase_hit(query: Column, doc: Column) -> Column:
    """n/6 for the longest n of 4, 3, 2 of which a character n-gram of the query is in the document."""
    q, d = F.lower(query), F.lower(doc)
    out = F.lit(0.0)
    for n in (2, 3, 4):
        found = F.exists(_grams(q, n), lambda g: d.contains(g))
        out = F.when((F.length(q) >= n) & found, F.lit(n / 6.0)).otherwise(out)
    return out


def _grams(q: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - n + 1, F.lit(1))), lambda i: q.substr(i, F.lit(n)))


def number_hit(query: Column, doc: Column) -> Column:
    """0.25 if a dotted number of the query is in the document."""
    return F.when(F.exists(F.regexp_extract_all(query, F.lit(r"\d+(?:\.\d+){1,3}"), F.lit(0)), lambda m: doc.contains(m)), 0.25).otherwise(0.0)


def token_key(c: Column, n: int = 6) -> Column:
    """First n of the sorted distinct tokens; a hash of the text if it has none."""
    t = F.slice(F.array_sort(F.array_distinct(tokenize(c))), 1, n)
    return F.when(F.size(t) > 0, F.array_join(t, " ")).otherwise(F.substring(F.sha2(F.lower(F.trim(text_or_empty(c))), 256), 1, 32))


def report_key(c: Column) -> Column:
    """First five of the sorted distinct tokens; the first 20 characters of a text that has none."""
    t = F.slice(F.array_sort(F.array_distinct(tokenize(c))), 1, 5)
    return F.when(F.size(t) > 0, F.array_join(t, " ")).otherwise(F.substring(text_or_empty(c), 1, 20))


def top_keywords(c: Column, k: int) -> Column:
    """The k most frequent tokens of two characters or more; longer ones and then earlier ones first among equals. For short texts."""
    t = F.filter(tokenize(c), lambda x: F.length(x) >= 2)
    each = F.transform(F.array_distinct(t), lambda w: F.struct((-F.size(F.filter(t, lambda x: x == w))).alias("n"), (-F.length(w)).alias("l"), F.array_position(t, w).alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda x: x["w"])


def request_key(query: Column, context: Column) -> Column:
    return F.sha2(F.concat(text_or_empty(query), F.lit("|"), F.to_json(context)), 256)
