"""Queries of the retrieval stages over stored indexes, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import answers, evaluate, intents, retrieve
from corpuslens.plans import stored
from corpuslens.plans import views as V
from corpuslens.plans.registry import _BM25, _FUSED, _GOLD, _VEC, _golden, _hybrid, intent_sql, query

#: Words that occur in the given texts, in place of the engine's own lexicon: every intent but small talk has items.
RULES = (
    ("spec_lookup", ["erth", "hend", "ndth"], 0.0),
    ("quality_diagnosis", ["thre", "anon"], 0.05),
    ("scheme_generation", ["heer", "whon", "ouw"], 0.05),
    ("case_retrieval", ["ción", "ung"], 0.05),
    ("chitchat", ["zzz"], 0.0),
)
#: Below this a best score counts as weak in these texts, whose scores are lower than those of real questions.
FLOOR = 0.45


def planned_items(spark, sf_dir) -> DataFrame:
    """Benchmark items with intent, domains and limits."""
    return intents.planned(intents.classified(V.query_v(spark, sf_dir), RULES))


def _parts(spark, sf_dir) -> DataFrame:
    q = V.query_v(spark, sf_dir)
    return intents.sub_queries(q.withColumn("query", F.replace("query", F.lit(","), F.lit("?"))))


def _codes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each fourth item asks for a code of which every fifth document has one."""
    i = F.col("query_id")
    asked = V.query_v(spark, sf_dir).select("query_id", F.when(i % 4 == 0, F.array(F.lit("GB50010-2010"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    return asked, V.document_v(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "GB 50010-2015").otherwise("").alias("standard_code"))


def candidates(spark, sf_dir) -> DataFrame:
    return retrieve.retrieved(stored.terms(spark, sf_dir), stored.vectors(spark, sf_dir), planned_items(spark, sf_dir), _parts(spark, sf_dir), _codes(spark, sf_dir))


_PLANS = ", ".join(f"('{k}', {list(d)!r}::varchar[], {n}, {t}::double, {v}::double, {b}::double)" for k, (d, _, n, t, v, b) in intents.PLANS.items())
#: Requests, in place of the queries of `_BM25` and `_VEC`.
_ASKED = {
    **intent_sql("SELECT item_id AS query_id, text FROM benchmark", "query_id", RULES),
    "plans": f"SELECT * FROM (VALUES {_PLANS}) p(intent, domains, top_k, threshold, vector_weight, bm25_weight)",
    "main": "SELECT query_id AS own, 0 AS part, b.text AS query, top_k, threshold, vector_weight, bm25_weight, domains FROM i5 JOIN plans USING (intent) JOIN benchmark b ON b.item_id = query_id",
    "split": "SELECT item_id AS own, unnest(p[1:3]) AS query, unnest(range(1, least(len(p), 3) + 1))::int AS part FROM (SELECT item_id, list_filter(list_transform(string_split_regex(replace(text, ',', '?'), '[?？;；]|以及|还有'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 6) AS p FROM benchmark) WHERE len(p) > 1",
    "reqs": "SELECT *, own || '#' || part AS rid FROM (SELECT * FROM main UNION ALL BY NAME SELECT s.own, s.part, s.query, greatest(4, m.top_k // 3)::int AS top_k, 0.15::double AS threshold, 0.6::double AS vector_weight, 0.4::double AS bm25_weight, m.domains FROM split s JOIN main m ON m.own = s.own)",
    "query_v": "SELECT rid AS query_id, query FROM reqs",
}
_BY_ROW = """SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY fusion_score DESC, doc_id) AS place FROM (
  SELECT r.rid, r.own, r.part, r.top_k, doc_id, d.kb_id, d.domain, v.score AS vector_score, v.rank AS vector_rank, b.score AS bm25_score, b.rank AS bm25_rank, r.threshold,
    round((0.5 * (coalesce(vector_weight / (60 + v.rank), 0) + coalesce(bm25_weight / (60 + b.rank), 0)) * 60 + 0.5 * (vector_weight * coalesce(v.score, 0) + bm25_weight * coalesce(b.score, 0)))
      * CASE WHEN v.rank IS NOT NULL AND b.rank IS NOT NULL THEN 1.12::double ELSE 1.0::double END * CASE WHEN list_contains(domains, d.domain) THEN 1.0::double + 0.06::double * (len(domains) - list_position(domains, d.domain) + 1) ELSE 1.0::double END, 6) AS fusion_score
  FROM (SELECT vr.* FROM vr JOIN reqs ON rid = query_id WHERE rank <= top_k) v
  FULL JOIN (SELECT query_id, doc_id, rank, score FROM (SELECT bm.query_id, doc_id, rank, top_k, round(s / max(s) OVER (PARTITION BY bm.query_id), 6) AS score FROM bm JOIN reqs ON rid = query_id) WHERE rank <= 2 * top_k) b USING (query_id, doc_id)
  JOIN reqs r ON r.rid = query_id JOIN document_v d USING (doc_id)) WHERE fusion_score >= threshold) f WHERE place <= top_k"""
_FOUND = {
    "by_row": _BY_ROW,
    "seen": "SELECT * REPLACE (CASE WHEN part > 0 THEN round(fusion_score * 0.9::double, 6) ELSE fusion_score END AS fusion_score) FROM by_row QUALIFY row_number() OVER (PARTITION BY own, doc_id ORDER BY part) = 1",
    "coded": "SELECT * REPLACE (CASE WHEN own % 4 = 0 AND doc_id % 5 = 0 THEN round(fusion_score * 1.35::double, 6) ELSE fusion_score END AS fusion_score) FROM seen",
    "cands": "SELECT own AS query_id, doc_id, kb_id, domain, part, vector_score, vector_rank, bm25_score, bm25_rank, fusion_score, row_number() OVER (PARTITION BY own ORDER BY fusion_score DESC, doc_id) AS rank FROM coded",
}
_CANDS = {**_ASKED, **_BM25, **_VEC, **_FOUND}


@query(V.sql("SELECT * FROM cands", "document_v", **_CANDS))
def retrieved_candidates(spark, sf_dir):
    """Candidates of the benchmark items by the plan of their intents, with what their parts found, raised where a code fits."""
    return candidates(spark, sf_dir).select("query_id", "doc_id", "kb_id", "domain", "part", "vector_score", "vector_rank", "bm25_score", "bm25_rank", "fusion_score", "rank")


def lexical_sql(q: str, qt: str, d: str, dt: str) -> str:
    """Token cover, phrase, number and mandatory signals of the query text and tokens against those of a document."""
    grams = " ".join(f"WHEN length({q}) >= {n} AND len(list_filter(range(1, length({q}) - {n} + 2), lambda i: contains(lower({d}), substring(lower({q}), i, {n})))) > 0 THEN {n} / 6.0::double" for n in (4, 3, 2))
    return f"""0.55::double * CASE WHEN len({qt}) > 0 THEN len(list_intersect(list_distinct({qt}), {dt})) / len(list_distinct({qt})) ELSE 0 END + 0.20::double * CASE {grams} ELSE 0 END
      + CASE WHEN len(list_filter(regexp_extract_all({q}, '\\d+(?:\\.\\d+){{1,3}}'), lambda m: contains({d}, m))) > 0 THEN 0.25::double ELSE 0 END + CASE WHEN regexp_matches({d}, '必须|严禁|不得') THEN 0.1::double ELSE 0 END"""


def ranked_sql(cands: str, rid: str, keep: int = 6) -> dict[str, str]:
    """Reranked rows of `cands` (query_id, doc_id, fusion_score ...), whose query is the request `rid`."""
    return {
        "pair": f"SELECT c.*, d.text, d.governance_status, d.title, q.query, dt.t AS dtok, qt.t AS qtok FROM {cands} c JOIN document_v d USING (doc_id) JOIN dt USING (doc_id) JOIN query_v q ON q.query_id = {rid} JOIN qt ON qt.query_id = {rid}",
        "cosines": f"SELECT c.query_id, c.doc_id, sum(dv.v * qv.v) AS cosine FROM {cands} c JOIN dv ON dv.id = c.doc_id JOIN qv ON qv.id = {rid} AND qv.bucket = dv.bucket GROUP BY 1, 2",
        "rr0": f"SELECT pair.*, round(least(0.65::double * greatest(coalesce(cosine, 0), 0) + 0.35::double * ({lexical_sql('query', 'qtok', 'text', 'dtok')}), 1.0), 6) AS rerank_score FROM pair LEFT JOIN cosines USING (query_id, doc_id)",
        "rr1": f"SELECT *, regexp_matches(substring(text, 1, 150), '必须|严禁|不得|禁止') AS is_mandatory FROM rr0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) <= {3 * keep}",
        "rr2": "SELECT *, round((0.65::double * rerank_score + 0.35::double * least(fusion_score, 1.0)) * CASE WHEN is_mandatory THEN 1.10::double ELSE 1.0 END * CASE governance_status WHEN 'deprecated' THEN 0.55::double WHEN 'need_update' THEN 0.85::double ELSE 1.0 END, 6) AS final_score FROM rr1",
        "rr3": f"SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank FROM rr2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) <= {keep}",
        "rr": f"SELECT *, NOT (max(final_score) OVER (PARTITION BY query_id) >= {FLOOR} AND count(*) FILTER (final_score >= {FLOOR} * 0.75) OVER (PARTITION BY query_id) >= 2) AS rejected FROM rr3",
    }


def _delivered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = retrieve.written(candidates(spark, sf_dir), "candidates")
    docs = V.document_v(spark, sf_dir).select("doc_id", "text", "title", "governance_status")
    return c, retrieve.delivered(retrieve.with_texts(c, V.query_v(spark, sf_dir), docs), floor=FLOOR)


_RANKED = ranked_sql("cands", "c.query_id || '#0'")
_SHARED = "list_sort(list_intersect(list_distinct(qtok), dtok))"


@query(V.sql("SELECT query_id, doc_id, rerank_score, final_score, rank, rejected FROM rr", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED, **ranked_sql("fused", "c.query_id")))
def reranked_candidates(spark, sf_dir):
    """Fused candidates reranked with cosine and lexical signals, boosted by status, behind the relevance floor."""
    docs = V.document_v(spark, sf_dir).select("doc_id", "text", "governance_status")
    c = retrieve.with_texts(_hybrid(spark, sf_dir), V.query_v(spark, sf_dir), docs)
    return retrieve.delivered(c).select("query_id", "doc_id", "rerank_score", "final_score", "rank", "rejected")


@query(V.sql(f"""SELECT query_id, doc_id, rank, domain, CASE WHEN length(text) > 160 THEN text[1:160] || '…' ELSE text END AS snippet, coalesce(vector_score, 0) AS vector_score, vector_rank, coalesce(bm25_score, 0) AS bm25_score, bm25_rank, fusion_score, rerank_score, final_score,
  {_SHARED} AS matched_terms, len({_SHARED})::int AS match_count, is_mandatory, governance_status, NOT rejected AS used, CASE WHEN vector_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN 'both' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'bm25' END AS signal FROM rr""", "document_v", **_CANDS, **_RANKED))  # fmt: skip
def explained_candidates(spark, sf_dir):
    """Scores, ranks, shared terms and use of what was delivered, or rejected, for each benchmark item."""
    return retrieve.explained_rows(*_delivered(spark, sf_dir), floor=FLOOR)[0]


@query(V.sql(f"""SELECT query_id, candidate_count, count(*) FILTER (NOT rejected) AS final_count, count(vector_rank) AS n_vector, count(bm25_rank) AS n_bm25, count(*) FILTER (vector_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS n_both, max(final_score) AS top_score,
  count(*) FILTER (final_score >= {FLOOR} * 0.75) AS support, bool_or(rejected) AS below_floor, CASE WHEN bool_or(rejected) THEN printf('best %.3f, %d near it: at least {FLOOR} and 2 of {FLOOR * 0.75:.4f} are asked for', max(final_score), count(*) FILTER (final_score >= {FLOOR} * 0.75)) END AS rejection_reason
  FROM rr JOIN (SELECT query_id, count(*) AS candidate_count FROM cands GROUP BY 1) USING (query_id) GROUP BY 1, 2""", "document_v", **_CANDS, **_RANKED))  # fmt: skip
def explained_queries(spark, sf_dir):
    """How many candidates each item had, what the channels found of those delivered, and why a list was rejected."""
    return retrieve.explained_rows(*_delivered(spark, sf_dir), floor=FLOOR)[1]


_RUN = """SELECT count(*) FILTER (n_rel > 0) AS n_positive, count(*) FILTER (n_rel = 0) AS n_negative, {}, {},
  round(coalesce(avg(coalesce(1.0 / d_first, 0)) FILTER (n_rel > 0), 0), 4) AS mrr, round(coalesce(avg((d_hits > 0)::int) FILTER (n_rel > 0), 0), 4) AS hit_rate, round(coalesce(avg((d_hits = n_rel)::int) FILTER (n_rel > 0), 0), 4) AS full_hit_rate,
  round(coalesce(avg(below::int) FILTER (n_rel > 0), 0), 4) AS below_floor_rate, round(coalesce(avg((d_hits = 0)::int) FILTER (n_rel = 0), 0), 4) AS correct_rejection_rate, round(coalesce(avg(below::int) FILTER (n_rel = 0), 0), 4) AS negative_floor_rate FROM per""".format(
    ", ".join(f"round(coalesce(avg(d_hits_{k} / n_rel) FILTER (n_rel > 0), 0), 4) AS recall_{k}, round(coalesce(avg(coalesce(d_dcg_{k}, 0) / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda r: 1.0 / (r + 1)))) FILTER (n_rel > 0), 0), 4) AS ndcg_{k}" for k in (1, 3, 5)),
    ", ".join(f"round(coalesce(avg(c_hits_{k} / n_rel) FILTER (n_rel > 0), 0), 4) AS candidate_recall_{k}" for k in (1, 3, 5, 10, 20)),
)
_PER = "SELECT item_id, n_rel, coalesce(below, false) AS below, d_first, coalesce(d_hits, 0) AS d_hits, {} FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n_rel0 FROM gold GROUP BY 1) g ON g.query_id = item_id LEFT JOIN dm ON dm.query_id = item_id LEFT JOIN cm ON cm.query_id = item_id LEFT JOIN (SELECT query_id, bool_or(rejected) AS below FROM rr GROUP BY 1) f ON f.query_id = item_id, LATERAL (SELECT coalesce(n_rel0, 0) AS n_rel)".format(
    ", ".join([f"coalesce(d_hits_{k}, 0) AS d_hits_{k}, d_dcg_{k}" for k in (1, 3, 5)] + [f"coalesce(c_hits_{k}, 0) AS c_hits_{k}" for k in (1, 3, 5, 10, 20)])
)
_EVAL = {
    "gold": _GOLD,
    "dm": "SELECT query_id, min(rank) AS d_first, count(*) AS d_hits, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS d_hits_{k}, sum(1.0 / (rank + 1)) FILTER (rank <= {k}) AS d_dcg_{k}" for k in (1, 3, 5)) + " FROM rr JOIN gold USING (query_id, doc_id) WHERE NOT rejected GROUP BY 1",
    "cm": "SELECT query_id, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS c_hits_{k}" for k in (1, 3, 5, 10, 20)) + " FROM cands JOIN gold USING (query_id, doc_id) GROUP BY 1",
    "per": _PER,
}


@query(V.sql(_RUN, "document_v", **_CANDS, **_RANKED, **_EVAL))
def evaluation_run(spark, sf_dir):
    """One whole run over the benchmark items: routed, split, retrieved, reranked and held against the floor, then scored."""
    c, d = _delivered(spark, sf_dir)
    return evaluate.full_run(V.query_v(spark, sf_dir), _golden(spark, sf_dir), c, d)


@query(V.sql(f"""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank, domain, title, CASE WHEN length(text) > 500 THEN text[1:500] || '…' ELSE text END AS content, is_mandatory, coalesce(vector_score, 0) AS vector_score, coalesce(bm25_score, 0) AS bm25_score, fusion_score, rerank_score, final_score, {_SHARED} AS matched_terms
  FROM (SELECT *, round(round(0.65::double * rerank_score + 0.35::double * least(fusion_score, 1.0), 9), 6) AS final_score, regexp_matches(substring(text, 1, 150), '必须|严禁|不得|禁止') AS is_mandatory FROM rr0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) <= 10)""",
  "document_v", reqs="SELECT item_id || '#0' AS rid, item_id AS own, 0 AS part, text AS query, 30 AS top_k, 0.15::double AS threshold, 0.6::double AS vector_weight, 0.4::double AS bm25_weight, []::varchar[] AS domains FROM benchmark",
  query_v=_ASKED["query_v"], **_BM25, **_VEC, by_row=_BY_ROW, pool="SELECT own AS query_id, doc_id, domain, vector_score, vector_rank, bm25_score, bm25_rank, fusion_score, place AS rank FROM by_row", **ranked_sql("pool", "c.query_id || '#0'")))
def search_page(spark, sf_dir):
    """The ten best documents of each benchmark item out of a reranked pool of thirty, as a search page shows them."""
    docs = V.document_v(spark, sf_dir).select("doc_id", "text", "title", "governance_status")
    return retrieve.searched(stored.terms(spark, sf_dir), stored.vectors(spark, sf_dir), V.query_v(spark, sf_dir), docs)


#: One domain for an intent, so that a narrow search can miss; documents are pieces of parents of a hundred, and count as scattered below higher scores.
_NARROW = {"spec_lookup": ["standard"], "quality_diagnosis": ["case"], "scheme_generation": ["enterprise"], "case_retrieval": ["project"], "unknown": ["standard", "case", "enterprise"], "chitchat": []}
_MISS_FLOOR, _SCATTERED = 0.35, 0.9


def _attributed_sql(floor: float, scattered: float) -> str:
    """The inputs of `missed` with the rules that fire, surest first, and the verdict."""
    return f"""SELECT query_id, n_intent, n_broad, top_fusion, top_broad, top_rerank, mean_bm25, mean_vector, most_of_one, codes, CASE WHEN len(codes) = 0 THEN 'retrieval_ok' WHEN list_contains(codes, 'missing_doc') THEN 'missing_doc' WHEN list_contains(codes, 'intent_misroute') THEN 'intent_misroute' WHEN list_contains(codes, 'chunking_bad') THEN 'chunking_bad' ELSE 'rewrite_drift' END AS verdict
  FROM (SELECT *, list_transform(list_reverse_sort(list_filter([
    CASE WHEN n_intent = 0 AND n_broad = 0 THEN '0.95 missing_doc' WHEN n_intent > 0 AND top_rerank < {floor} * 0.6 THEN '0.70 missing_doc' END,
    CASE WHEN n_intent = 0 AND n_broad > 0 THEN '0.85 intent_misroute' WHEN n_intent > 0 AND top_broad > top_fusion * 1.3 AND n_broad > n_intent THEN '0.60 intent_misroute' WHEN intent_confidence < 0.5 THEN '0.40 intent_misroute' END,
    CASE WHEN n_intent > 0 AND mean_bm25 > 0 AND mean_vector > 0 AND mean_bm25 > mean_vector * 1.6 AND top_rerank >= {floor} * 0.5 THEN '0.50 rewrite_drift' END,
    CASE WHEN most_of_one >= 3 AND top_fusion < {scattered} AND top_rerank >= {floor} * 0.5 THEN '0.45 chunking_bad' END], lambda x: x IS NOT NULL)), lambda x: x[6:]) AS codes FROM missed)"""


def _missed_sql(**asked: str) -> dict[str, str]:
    """The inputs of the rules, as `missed`, of items `asked` (own, domains, intent_confidence, query): within their domains and anywhere."""
    return {
        **intent_sql("SELECT item_id AS query_id, text FROM benchmark", "query_id", RULES),
        **asked,
        "query_v": "SELECT own AS query_id, query FROM asked",
        **_BM25,
        **_VEC,
        "tags": "SELECT own, 'intent' AS tag, domains FROM asked UNION ALL SELECT own, 'broad', ['standard', 'case', 'enterprise', 'project'] FROM asked",
        "tv": "SELECT own, tag, doc_id, score, row_number() OVER (PARTITION BY own, tag ORDER BY score DESC, doc_id) AS rank FROM tags JOIN vs ON query_id = own JOIN document_v d USING (doc_id) WHERE list_contains(domains, d.domain) QUALIFY rank <= 10",
        "tb": "SELECT own, tag, doc_id, round(s / max(s) OVER (PARTITION BY own, tag), 6) AS score, rank FROM (SELECT own, tag, doc_id, s, row_number() OVER (PARTITION BY own, tag ORDER BY s DESC, doc_id) AS rank FROM tags JOIN (SELECT * FROM s1 WHERE s > 0) x ON x.query_id = own JOIN document_v d USING (doc_id) WHERE list_contains(domains, d.domain) QUALIFY rank <= 20)",
        "tagged": """SELECT * FROM (SELECT own AS query_id, tag, doc_id, tv.score AS vector_score, tb.score AS bm25_score, round((0.5 * (coalesce(0.6 / (60 + tv.rank), 0) + coalesce(0.4 / (60 + tb.rank), 0)) * 60 + 0.5 * (0.6 * coalesce(tv.score, 0) + 0.4 * coalesce(tb.score, 0)))
    * CASE WHEN tv.rank IS NOT NULL AND tb.rank IS NOT NULL THEN 1.12 ELSE 1.0 END, 6)::double AS fusion_score FROM tv FULL JOIN tb USING (own, tag, doc_id)) WHERE fusion_score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id, tag ORDER BY fusion_score DESC, doc_id) <= 10""",
        "narrow": "SELECT query_id, doc_id, fusion_score, 0 AS rank FROM tagged WHERE tag = 'intent'",
        **ranked_sql("narrow", "c.query_id"),
        "missed": """SELECT a.own AS query_id, intent_confidence, coalesce(n_intent, 0) AS n_intent, coalesce(n_broad, 0) AS n_broad, coalesce(top_fusion, 0) AS top_fusion, coalesce(top_broad, 0) AS top_broad, coalesce(mean_bm25, 0) AS mean_bm25, coalesce(mean_vector, 0) AS mean_vector, coalesce(top_rerank, 0) AS top_rerank, coalesce(most_of_one, 0) AS most_of_one
    FROM asked a LEFT JOIN (SELECT query_id, count(*) FILTER (tag = 'intent') AS n_intent, count(*) FILTER (tag = 'broad') AS n_broad, max(fusion_score) FILTER (tag = 'intent') AS top_fusion, max(fusion_score) FILTER (tag = 'broad') AS top_broad,
      round(avg(coalesce(bm25_score, 0)) FILTER (tag = 'intent'), 9) AS mean_bm25, round(avg(coalesce(vector_score, 0)) FILTER (tag = 'intent'), 9) AS mean_vector FROM tagged GROUP BY 1) m ON m.query_id = a.own
    LEFT JOIN (SELECT query_id, max(rerank_score) AS top_rerank FROM rr0 GROUP BY 1) r ON r.query_id = a.own LEFT JOIN (SELECT query_id, max(n) AS most_of_one FROM (SELECT query_id, doc_id // 100, count(*) AS n FROM narrow GROUP BY 1, 2) GROUP BY 1) o ON o.query_id = a.own""",
    }


def _attributed(spark, sf_dir, asked: DataFrame, floor: float, scattered: float) -> DataFrame:
    """The inputs, rules that fire and verdict of `asked` items."""
    docs = V.document_v(spark, sf_dir).select("doc_id", "text", F.floor(F.col("doc_id") / 100).alias("parent"))
    return answers.attributed(retrieve.miss_inputs(stored.terms(spark, sf_dir), stored.vectors(spark, sf_dir), asked, docs, parent="parent"), floor, scattered)


_AIMS = f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r}::varchar[])' for k, v in _NARROW.items())}) a(intent, domains)"


@query(V.sql(_attributed_sql(_MISS_FLOOR, _SCATTERED), "document_v", **_missed_sql(aims=_AIMS, asked="SELECT query_id AS own, domains, intent_confidence, text AS query FROM i5 JOIN aims USING (intent) JOIN benchmark ON item_id = query_id")))
def attributed_misses(spark, sf_dir):
    """Why items miss, from the intent's domains against all: every input is computed, and each of the four rules has items."""
    aims = spark.createDataFrame(list(_NARROW.items()), "intent string, domains array<string>")
    q = intents.classified(V.query_v(spark, sf_dir), RULES).join(F.broadcast(aims), "intent")
    m = _attributed(spark, sf_dir, q, _MISS_FLOOR, _SCATTERED)
    return m.select("query_id", "n_intent", "n_broad", "top_fusion", "top_broad", "top_rerank", "mean_bm25", "mean_vector", "most_of_one", F.transform("reasons", lambda r: r["code"]).alias("codes"), "verdict")


@query(V.sql(f"SELECT query_id, n_intent, n_broad, verdict FROM ({_attributed_sql(FLOOR, 0.6)})", "document_v", **_missed_sql(asked="SELECT query_id AS own, ['standard'] AS domains, intent_confidence, text AS query FROM i5 JOIN benchmark ON item_id = query_id")))
def miss_attribution(spark, sf_dir):
    """Why items miss when only one domain is searched, against all domains: two retrievals, the narrow one reranked, at the engine's own floor."""
    q = intents.classified(V.query_v(spark, sf_dir), RULES).withColumn("domains", F.array(F.lit("standard")))
    return _attributed(spark, sf_dir, q, FLOOR, 0.6).select("query_id", "n_intent", "n_broad", "verdict")
