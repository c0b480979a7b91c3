"""Personal data by weak supervision, with DataFrame functions only.

Fixed base patterns give spans that always stay. Looser patterns give candidates of eight further kinds, on each of which four
labelers vote: a strict form (regex, checksum, calendar), word lists (gazetteer), the words in front (context), and what stands
beside it (other personal data, or signs of a path or an amount). The votes of all candidates are counted by pattern;
expectation-maximisation on that table, whose size the number of labelers bounds, estimates how reliable each labeler is, and
a logistic span classifier is trained on the posteriors and applied as an expression. A candidate that no labeler speaks for
is not kept.

The word lists are a parameter: `GAZETTEERS`, or a table of (list, entry) by `gazetteers`, of at most `MAX_ENTRIES` entries, as
they become part of the expression.

Positions are code points, ends exclusive. Cases: null and empty texts have no spans. A candidate that overlaps a base
span is dropped. Repeated rows are rows of their own; columns other than `doc_id` and `text` are ignored. With no
candidate at all, nothing is trained and base spans alone are returned. Starts are running sums taken block by block, so the
work on a very long text with very many matches grows with its length, but for candidates times base spans in one text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import only, saved, table

KINDS = ("email", "ip", "card", "phone", "secret", "local_phone", "id_number", "iban", "birth_date", "person", "street", "passport")
BASE = 4
MAX_ENTRIES = 100_000
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"\p{Lu}\p{Ll}++"
#: Possessive forms of the base patterns: same matches, no backtracking over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{2,}+[=:][^\s,;=:]{8,}+(?:={1,2}(?![^\s,;]))?|(?<![A-Za-z0-9_])(?:AKIA|gh[pos]_|sk-)[A-Za-z0-9]{12,}+",
    "local_phone": r"(?<![0-9A-Za-z+().-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|(?:00[1-9][0-9]{0,2}|0[1-9][0-9]{1,4})[\x20/.-][0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3})(?![0-9A-Za-z])",
    "id_number": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "birth_date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}([./-])[0-9]{{1,2}}\1[0-9]{{4}}|[0-9]{{1,2}}\.?\x20{_WORD}\x20[0-9]{{4}}|{_WORD}\x20[0-9]{{1,2}},\x20[0-9]{{4}})(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}\p{{N}}'-])(?<!\p{{Lu}}\p{{Ll}}{{1,20}}\x20)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20)?{_WORD}(?:[\x20-]\p{{Lu}}(?:\.|\p{{Ll}}++)){{1,3}}+(?!\x20\p{{Lu}}\p{{Ll}})(?![\p{{L}}\p{{N}}])",
    "street": rf"(?<![\p{{L}}\p{{N}}.,-])(?:[0-9]{{1,5}}[A-Za-z]?,?\x20(?:{_WORD}\x20){{1,3}}{_WORD}|[0-9]{{1,4}},?\x20\p{{Ll}}{{3,9}}\x20(?:\p{{Ll}}{{1,3}}\x20){{0,2}}{_WORD}|{_WORD}\x20[0-9]{{1,4}}[a-z]?)(?![\p{{L}}\p{{N}}])",
    "passport": r"(?<![0-9A-Za-z])(?:[A-Z]{1,2}[0-9]{6,9}|[A-Z][0-9]{2}[A-Z0-9]{6})(?![0-9A-Za-z])",
}
#: Texts without this, or without a match of it, cannot hold one of the pattern; all others need a digit.
_NEEDS = {"email": "@", "phone": "+"}
_NEEDS_MATCH = {"secret": r"[=:]|AKIA|gh[pos]_|sk-", "person": r"\p{Lu}\p{Ll}+[\x20-]\p{Lu}", "iban": "[A-Z]{2}[0-9]{2}", "passport": "[A-Z][0-9]{2}"}
#: Forms that speak for a candidate, and forms that speak against it; where a kind has no form against, all others do.
_STRICT = {
    "secret": r"[=:](?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[A-Za-z0-9_/+.-]{12,}={0,2}$|^(?:AKIA[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})([\x20.-])[2-9][0-9]{2}\1?[\x20.-]?[0-9]{4}$|^0(?:[^0-9]*[0-9]){8,14}$",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "birth_date": r"^(?:(?:19[0-9]{2}|20[012][0-9])-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19[0-9]{2}|20[012][0-9])|(?=.*(?:19[0-9]{2}|20[012][0-9])$)(?:\p{L}+\x20)?(?:0?[1-9]|[12][0-9]|3[01])[.,]?\x20.*)$",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b|\x20\p{Lu}\.",
    "street": r"^(?!19[0-9]{2}|20[0-9]{2})[0-9]{1,5}[A-Za-z]?,?\x20(?:\p{L}+\x20)+\p{L}+$|^\p{Lu}\p{Ll}{4,}\x20[0-9]",
    "passport": r"^[A-Z]{1,2}[0-9]{7,8}$|^[A-Z][0-9]{2}[A-Z0-9]{6}$",
}
_AGAINST_FORM = {"person": r"(?i)(?<!\p{L})(\p{L}+)\x20(?:.*\x20)?\1(?!\p{L})"}
#: Words right in front of a candidate that speak for it. For the last three kinds, none of them there speaks against it.
_CONTEXT = {
    "secret": "password|login|secret|token|key|credentials?",
    "local_phone": "phone|call|tel|telefon|telephone|mobile|cell|fax|contact|dial|at",
    "id_number": "ssn|social|security|security number|tax id",
    "iban": "iban|account|bank|konto|compte|transfer to|pay to",
    "person": "name|name is|contact|dear|signed|regards|sincerely|attn|patient|by|called",
    "street": "address|lives at|living at|lives in|home|resides at|located at|ship to|deliver to|adresse|wohnt in",
    "birth_date": "born|born on|birth|date of birth|dob|birthday|geboren am|geboren|née le|né le|nacido el",
    "passport": "passport|passport no|passport number|travel document|document no|reisepass|passeport",
}
_MUST = ("birth_date", "passport")
_AGAINST = r"(?i)(?:version|page|isbn|chapter|figure|table|item|order|http|https|the|university of|part|model|invoice)[^\p{L}\n]{0,12}$"
#: Beside a candidate: other personal data, or signs of a path, a code or an amount.
_NEAR = r"@[A-Za-z0-9-]+\.[A-Za-z]|\+[0-9]{1,3}[\x20(]|(?i:\b(?:e-?mail|phone|tel|iban|passport|born|dob|address|ssn)\b)"
_FAR_FRONT, _FAR_BACK = r"[/#\\$€£_]$", r"^[/#\\%€£_]"
LABELERS = ("strict", "gazetteer", "context", "beside")

#: The word lists when no others are given.
GAZETTEERS: dict[str, tuple[str, ...]] = {
    "keys": tuple("pass password passwd pwd secret token key api_key apikey access_key accesskey secret_key secretkey private_key privatekey auth bearer credential".split()),
    "prefixes": ("AKIA", "ghp_", "gho_", "ghs_", "sk-"),
    "given_names": tuple(
        "adam ahmed alan albert alex alexander ali alice amy ana andrea andrew angela anna anne anthony antonio barbara ben benjamin brian carlos carol caroline "
        "catherine charles charlotte chris christian christine christopher claire clara claudia daniel david deborah diana diego donald edward elena elizabeth emily "
        "emma eric eva fatima felix fernando francesca francis frank gabriel george giovanni grace hanna hannah hans heinz helen henry ibrahim ingrid isabel jack "
        "jacob james jan jane jean jennifer jessica joan john jonas jose joseph juan julia julie karen karl katharina kevin klaus laura lena leon linda lisa louis "
        "lucas lucia luis luke maria marie mario mark marta martin mary matthew max michael miguel mohammed monika nancy nicole olga oliver pablo patricia paul "
        "pedro peter petra philip pierre rachel richard robert rosa ruth samuel sandra sara sarah sofia sophie stefan stephen steven susan thomas ursula victor "
        "william wolfgang yusuf".split()
    ),
    "streets": tuple("street st road rd avenue ave lane ln drive dr court ct boulevard blvd square terrace way rue place chemin allée straße strasse weg platz allee gasse calle via plaza".split()),
    "months": tuple("january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec januar februar märz mai juni juli oktober dezember".split()),
    "iban_lengths": tuple(
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 "
        "IS26 IT27 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 "
        "UA29 XK20".split()
    ),
    "dial_codes": tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 420 421".split()),
    "void_ids": ("078-05-1120", "219-09-9999"),
    "nationalities": tuple("american austrian belgian brazilian british canadian chinese danish dutch french german greek indian irish italian japanese mexican polish portuguese spanish swedish swiss turkish".split()),
}


def gazetteers(words: DataFrame) -> dict[str, tuple[str, ...]]:
    """Word lists of a table of (list, entry), in place of those of the same name; other lists stay."""
    entry = F.when(F.col("list").isin("prefixes", "iban_lengths"), F.trim("entry")).otherwise(F.lower(F.trim("entry")))
    rows = words.select("list", entry.alias("entry")).where("list IS NOT NULL AND entry <> ''").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"word lists of more than {MAX_ENTRIES} entries do not fit an expression")
    return GAZETTEERS | {n: tuple(sorted(r["entry"] for r in rows if r["list"] == n)) for n in {r["list"] for r in rows}}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, zero: Column, none: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """What `emit` makes of each item and the state before it, in blocks of 256, so that no long array is copied for each item."""

    def block(part: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), none.alias("out"))
        step = lambda acc, x: F.struct(advance(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        states = F.aggregate(parts, F.array(zero), lambda acc, part: F.concat(acc, F.array(F.aggregate(part, F.element_at(acc, -1), advance))))
        return F.flatten(F.zip_with(parts, F.slice(states, 1, F.size(parts)), block))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda b: F.slice(x, b * 256 + 1, 256))
    return F.when(F.size(items) > 0, _let(_let(items, cut), whole)).otherwise(none)


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, match, front, back) of all matches; front and back are the nearest of the pieces between them."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,front:string,back:string>>")

    def pieces(gaps: Column) -> Column:
        return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))

    def advance(at: Column, x: Column) -> Column:
        return at + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def emit(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        front, back = F.substring(x["gap"], -60, 60), F.substring(x["next"], 1, 60)
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), front.alias("front"), back.alias("back"))
        return F.when(x["hit"].isNull(), none).otherwise(F.array(one))

    got = _running(_let(F.split(text, pattern, -1), pieces), F.lit(0), none, advance, emit)
    need = _NEEDS.get(KINDS[kind])
    return F.when(text.contains(need) if need else text.rlike(_NEEDS_MATCH.get(KINDS[kind], "[0-9]")), got).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(12, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base spans, by start, then kind."""

    def valid(i: int, kind: str) -> Column:
        return F.filter(_found(text, PATTERNS[kind], i), lambda s: _valid(kind, s["hit"]))

    return F.array_sort(F.concat(*[valid(i, k) for i, k in enumerate(KINDS[:BASE])]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _mod97(hit: Column) -> Column:
    """Whether the check digits of an account number hold."""
    plain = F.regexp_replace(hit, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, "(?!^)"), F.lit(0), add) == 1


def _strict(kind: str, hit: Column) -> Column:
    if kind == "iban":
        return _vote(_mod97(hit), F.lit(True))
    against = hit.rlike(_AGAINST_FORM[kind]) if kind in _AGAINST_FORM else F.lit(True)
    if kind in _AGAINST_FORM:
        return F.when(against, -1).otherwise(_vote(hit.rlike(_STRICT[kind]), F.lit(False)))
    return _vote(hit.rlike(_STRICT[kind]), against)


def _listed(kind: str, s: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """The vote of the word lists: for some kinds, what is not listed is voted against."""
    hit = s["hit"]
    words = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda w: w != "")
    among = lambda x, name: F.exists(words(x), lambda w: w.isin(*lists[name]))
    if kind == "secret":
        known = F.regexp_extract(F.lower(hit), "^([a-z0-9_]+)[=:]", 1).isin(*lists["keys"])
        for p in lists["prefixes"]:
            known = known | hit.startswith(p)
        return _vote(known, F.lit(False))
    if kind == "local_phone":
        code = F.regexp_extract(hit, r"^00([0-9]+)", 1)
        return _vote(code.isin(*lists["dial_codes"]), (code != "") | hit.rlike(r"^\(?[2-9]11"))
    if kind == "id_number":
        return _vote(F.lit(False), hit.isin(*lists["void_ids"]))
    if kind == "iban":
        plain = F.regexp_replace(hit, r"\x20", "")
        return _vote(F.concat(F.substring(plain, 1, 2), F.length(plain).cast("string")).isin(*lists["iban_lengths"]), F.lit(True))
    if kind == "birth_date":
        return _vote(among(hit, "months"), hit.rlike(r"\p{L}"))
    if kind == "person":
        return _vote(among(hit, "given_names"), F.lit(True))
    if kind == "street":
        ends = F.lit(False)
        for w in ("straße", "strasse", "weg", "platz", "allee", "gasse"):
            ends = ends | F.lower(hit).rlike(rf"\p{{L}}{{2}}{w}\x20[0-9]")
        return _vote(among(hit, "streets") | ends, F.lit(True))
    return _vote(among(F.concat_ws(" ", s["front"], s["back"]), "nationalities"), F.lit(False))


def _votes(spans: Column, kind: int, lists: dict[str, tuple[str, ...]]) -> Column:
    """Candidates of a kind with the labelers' votes (1 for, -1 against, 0 none) and coarse features of form."""
    name = KINDS[kind]

    def one(s: Column) -> Column:
        cue = s["front"].rlike(rf"(?i)(?<!\p{{L}})(?:{_CONTEXT[name]})(?:\x20(?:is|no|number|me|us|to))?[^\p{{L}}\n]{{0,12}}$")
        against = F.lit(True) if name in _MUST else s["front"].rlike(_AGAINST)
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            _strict(name, s["hit"]).alias("strict"), _listed(name, s, lists).alias("gazetteer"), _vote(cue, against).alias("context"),
            F.when(s["front"].rlike(_FAR_FRONT) | s["back"].rlike(_FAR_BACK), -1).otherwise(_vote(F.concat_ws(" ", s["front"], s["back"]).rlike(_NEAR), F.lit(False))).alias("beside"),
            F.least(F.floor(F.length(s["hit"]) / 8), F.lit(4)).cast("int").alias("size"),
            s["hit"].rlike("[0-9].*[0-9].*[0-9].*[0-9]").cast("int").alias("digits"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, *keep: str, lists: dict[str, tuple[str, ...]] = GAZETTEERS) -> DataFrame:
    """Base spans, candidates outside them with votes, and columns `keep` as they are."""
    text = F.col("text")
    given = only(docs, *keep).withColumn("doc", F.struct(*[F.col(f"`{c}`") for c in keep])).select("doc", F.coalesce("doc.text", F.lit("")).alias("text"))
    base = given.select("doc", "text", base_spans(text).alias("base"))

    def free(i: int, kind: str) -> Column:
        return _votes(F.filter(_found(text, PATTERNS[kind], i), lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))), i, lists)

    cand = F.concat(*[free(i, k) for i, k in enumerate(KINDS) if i >= BASE])
    return base.select("doc", F.transform("base", lambda s: s.dropFields("hit", "front", "back")).alias("base"), cand.alias("cand"))


def em(rows: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes: labelers are independent given the truth, with their own rates of each vote."""
    k = len(rows[0][0])
    prior = 0.5
    rate = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.15, 0: 0.35, -1: 0.5}} for _ in range(k)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v, _n in rows:
            a = log(prior) + sum(log(rate[j][1][v[j]]) for j in range(k))
            b = log(1 - prior) + sum(log(rate[j][0][v[j]]) for j in range(k))
            post[v] = 1 / (1 + exp(min(50.0, b - a)))
        total = sum(n for _, n in rows)
        prior = min(0.99, max(0.01, (sum(post[v] * n for v, n in rows) + 1) / (total + 2)))
        for j in range(k):
            for y in (0, 1):
                w = {x: 0.5 + sum(n * (post[v] if y else 1 - post[v]) for v, n in rows if v[j] == x) for x in (1, 0, -1)}
                rate[j][y] = {x: w[x] / sum(w.values()) for x in w}
            if rate[j][1][1] * rate[j][0][-1] < rate[j][0][1] * rate[j][1][-1]:  # a labeler is better than its opposite
                rate[j][0], rate[j][1] = rate[j][1], rate[j][0]
    return post


def features(kind: int, votes: tuple[int, ...], size: int, digits: int) -> list[float]:
    """Of a span, as the classifier's expression makes them."""
    out = [1.0, *(float(kind == i) for i in range(BASE, len(KINDS)))]
    for v in votes:
        out += [float(v == 1), float(v == -1)]
    return [*out, *(float(size == s) for s in range(5)), float(digits)]


def train(rows: list[tuple[int, tuple[int, ...], int, int, int]]) -> list[float]:
    """Weights of the logistic classifier from (kind, votes, size, digits, count)."""
    counts: dict[tuple[int, tuple[int, ...]], int] = {}
    for kind, votes, _, _, n in rows:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    post = {}
    for kind in {r[0] for r in rows}:
        own = em([(v, n) for (k, v), n in sorted(counts.items()) if k == kind])
        post |= {(kind, v): p for v, p in own.items()}
    x = [(features(k, v, s, d), post[k, v], n) for k, v, s, d, n in rows]
    total = sum(n for *_, n in x)
    w = [0.0] * len(x[0][0])
    for _ in range(400):
        grad = [1e-3 * a for a in w]
        for f, p, n in x:
            e = (1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True)))))) - p) * n / total
            for j, b in enumerate(f):
                if b:
                    grad[j] += e * b
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _score(c: Column, w: list[float]) -> Column:
    terms = [F.lit(w[0])]
    at = 1
    for i in range(BASE, len(KINDS)):
        terms.append(F.when(c["kind"] == i, w[at]).otherwise(0.0))
        at += 1
    for name, v in product(LABELERS, (1, -1)):
        terms.append(F.when(c[name] == v, w[at]).otherwise(0.0))
        at += 1
    for s in range(5):
        terms.append(F.when(c["size"] == s, w[at]).otherwise(0.0))
        at += 1
    terms.append(c["digits"] * w[at])
    return sum(terms[1:], terms[0])


def _decided(found: DataFrame) -> DataFrame:
    """`doc`, `base` and `spans`: labelers weighed and the classifier trained on all candidates found."""
    c = found.select(F.explode("cand").alias("c")).groupBy("c.kind", *[f"c.{x}" for x in LABELERS], "c.size", "c.digits").agg(F.count("*").alias("n"))
    rows = [(r["kind"], tuple(r[x] for x in LABELERS), r["size"], r["digits"], r["n"]) for r in c.collect()]  # a row for each pattern
    more = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if rows:
        w = train(sorted(rows))
        kept = F.filter("cand", lambda c: (_score(c, w) > 0) & (F.greatest(*[c[x] for x in LABELERS]) > 0))
        more = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("doc", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def find(docs: DataFrame, lists: dict[str, tuple[str, ...]] = GAZETTEERS) -> DataFrame:
    """doc_id, `base` and `spans` (start, kind, end), by start, then kind."""
    found = candidates(docs, "doc_id", "text", lists=lists)
    found = saved(found.withColumn("doc", F.col("doc").dropFields("text")), "pii")
    return _decided(found).select("doc.doc_id", "base", "spans")


def redacted(docs: DataFrame, lists: dict[str, tuple[str, ...]] = GAZETTEERS) -> DataFrame:
    """The documents, all columns, with each span of `text` replaced by its kind."""
    keep = docs.columns
    out = _decided(saved(candidates(docs, *keep, lists=lists), "pii"))
    text = redact(F.col("doc.text"), F.col("spans"))
    return out.select(*[(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in keep])


def named(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; where spans overlap, by that of the first. Cuts are made in blocks of 4,096."""
    kinds = F.array(*[F.lit(k.upper()) for k in KINDS])
    none = F.array().cast("array<string>")

    def between(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / 4096).cast("int"), F.floor(b / 4096).cast("int")
        first = F.get(blocks, i).substr(a % 4096 + 1, F.when(i == j, b - a).otherwise(4096))
        rest = F.concat(F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.get(blocks, j).substr(F.lit(1), b % 4096), F.lit("")))
        return F.concat(F.coalesce(first, F.lit("")), F.when(i == j, "").otherwise(rest))

    def cut(blocks: Column) -> Column:
        def emit(at: Column, s: Column) -> Column:
            part = F.concat(between(blocks, at, s["start"]), F.lit("["), F.get(kinds, s["kind"]), F.lit("]"))
            return F.when(s["start"] >= at, F.array(part)).otherwise(none)

        parts = _running(spans, F.lit(0), none, lambda at, s: F.greatest(at, s["end"]), emit)
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(blocks, last, F.length(text)))

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit("(?s).{1,4096}"), F.lit(0)), cut)).otherwise(text)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])], F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))
