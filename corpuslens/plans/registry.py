"""Queries of the retrieval and corpus-quality operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import hashed
from corpuslens.operators import answers, evaluate, governance, ingest, intents, lists, neighbours, quality, reports, search, versions
from corpuslens.plans import stored
from corpuslens.plans import views as V
from corpuslens.sources.sliced import fetched, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = lambda c: rf"list_filter(list_transform(regexp_extract_all({c}, '[\x{{4e00}}-\x{{9fa5}}]+|[a-zA-Z][a-zA-Z\-]*|\d+(?:\.\d+)*'), lambda x: lower(x)), lambda x: NOT list_contains([{_STOP}], x) AND (length(x) > 1 OR regexp_matches(x, '[\x{{4e00}}-\x{{9fa5}}]')))"
_BM25 = {
    "dt": f"SELECT doc_id, kb_id, {_TOK('text')} AS t FROM document_v",
    "sizes": "SELECT kb_id, count(*) AS n_docs, avg(len(t)) AS avgdl FROM dt GROUP BY 1",
    "post": "SELECT kb_id, doc_id, term, count(*) AS tf, dl FROM (SELECT kb_id, doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY ALL",
    "idf0": "SELECT kb_id, term, avgdl, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post JOIN sizes USING (kb_id) GROUP BY kb_id, term, avgdl, n_docs",
    "mean_idf": "SELECT kb_id, avg(idf) AS m FROM idf0 GROUP BY 1",
    "qt": f"SELECT query_id, {_TOK('query')} AS t FROM query_v",
    "q": "SELECT query_id, n_q, term, count(*) AS qtf FROM (SELECT query_id, len(list_distinct(t)) AS n_q, unnest(t) AS term FROM qt) GROUP BY ALL",
    "s0": """SELECT query_id, n_q, post.kb_id, doc_id, round(sum(qtf * (CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) + 0.01 * count(*), 6) AS s, count(*) AS overlap
        FROM post JOIN idf0 USING (kb_id, term) JOIN mean_idf USING (kb_id) JOIN q USING (term) GROUP BY ALL""",
    "s1": "SELECT query_id, kb_id, doc_id, CASE WHEN max(s) OVER (PARTITION BY query_id, kb_id) <= 0 THEN overlap / n_q ELSE s END AS s FROM s0",
    "bm": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s1 WHERE s > 0",
}


@query(V.sql("SELECT query_id, doc_id, kb_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score, rank FROM bm WHERE rank <= 5", "document_v", "query_v", **_BM25))
def bm25_top_documents(spark, sf_dir):
    """The five best documents of each benchmark item by BM25."""
    return stored.bm25(spark, sf_dir, V.query_v(spark, sf_dir), 5)


_VEC = {
    "df0": f"SELECT doc_id AS id, {_TOK('text')} AS t FROM document_v",
    "qf0": f"SELECT query_id AS id, {_TOK('query')} AS t FROM query_v",
    **{f"{x}g": f"SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS g FROM {x}f0" for x in "dq"},
    **{f"{x}b": f"SELECT id, ('0x' || substr(md5(g), 1, 8))::bigint % 1024 AS bucket, sum((CASE WHEN ('0x' || substr(md5(g), 9, 2))::int % 2 = 0 THEN 1.0 ELSE -1.0 END)::double * (1.0 + 0.15 * least(length(g), 8))::double) AS v FROM {x}g GROUP BY 1, 2" for x in "dq"},
    **{f"{x}v": f"SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {x}b" for x in "dq"},
    "vs": "SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(dv.v * qv.v), 6) AS score FROM dv JOIN qv USING (bucket) GROUP BY 1, 2",
    "vr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs",
}


@query(V.sql("SELECT query_id, doc_id, score, rank FROM vr WHERE rank <= 10", "document_v", "query_v", **_VEC))
def hash_vector_search(spark, sf_dir):
    """The ten nearest documents of each benchmark item by hashed text vectors."""
    return stored.cosine(spark, sf_dir, V.query_v(spark, sf_dir), 10)


_FUSED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, v.rank AS vector_rank, b.rank AS bm25_rank,
    round((0.5 * (coalesce(0.6 / (60 + v.rank), 0) + coalesce(0.4 / (60 + b.rank), 0)) * 60 + 0.5 * (0.6 * coalesce(v.score, 0) + 0.4 * coalesce(b.score, 0)))
      * CASE WHEN v.rank IS NOT NULL AND b.rank IS NOT NULL THEN 1.12 ELSE 1.0 END, 6) AS fusion_score
  FROM (SELECT * FROM vr WHERE rank <= 20) v FULL JOIN (SELECT query_id, doc_id, rank, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM bm WHERE rank <= 40) b USING (query_id, doc_id)
) WHERE fusion_score >= 0.15) WHERE rank <= 20"""


def _hybrid(spark, sf_dir):
    q = V.query_v(spark, sf_dir)
    return search.fuse(stored.cosine(spark, sf_dir, q, 20), stored.bm25(spark, sf_dir, q, 40))


@query(V.sql("SELECT query_id, doc_id, vector_rank, bm25_rank, fusion_score, rank FROM fused", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED))
def hybrid_search(spark, sf_dir):
    """Rank and score fusion of both channels."""
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", "vector_rank", "bm25_rank", "fusion_score", "rank")


def _golden(spark, sf_dir):
    """Documents that hold a benchmark text, a small, stated set."""
    return evaluate.containing(V.table(spark, sf_dir, "documents"), V.query_v(spark, sf_dir))


_GOLD = "SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"
_METRICS = """SELECT g.query_id, n_relevant, round(coalesce(1.0 / min(rank), 0), 4) AS mrr, {} FROM (SELECT query_id, count(*) AS n_relevant FROM gold GROUP BY 1) g
  LEFT JOIN (SELECT f.query_id, rank FROM fused f JOIN gold USING (query_id, doc_id)) h ON h.query_id = g.query_id GROUP BY 1, 2""".format(
    ", ".join(
        f"round(count(*) FILTER (rank <= {k}) / n_relevant, 4) AS recall_{k}, round(coalesce(sum(1.0 / (rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least(n_relevant, {k}) + 1), lambda r: 1.0 / (r + 1))), 4) AS ndcg_{k}"
        for k in (1, 3, 5)
    )
)


@query(V.sql("SELECT * FROM m", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED, gold=_GOLD, m=_METRICS))
def retrieval_metrics(spark, sf_dir):
    """Recall, NDCG and MRR of each item with relevant documents."""
    return evaluate.ranking_metrics(_hybrid(spark, sf_dir).select("query_id", "doc_id", "rank"), _golden(spark, sf_dir))


@query(V.sql(f"SELECT doc_id, len({_TOK('text')}) AS n_tokens, sha256(text) AS content_hash, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END AS short, coalesce(nullif(list_aggregate(list_sort(list_distinct({_TOK('text')}))[1:6], 'string_agg', ' '), ''), substring(sha256(lower(trim(text))), 1, 32)) AS gap_key FROM documents"))
def text_scalars(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").withColumn("t", T.tokenize(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), T.content_hash(F.col("text")).alias("content_hash"), T.truncate_to(F.col("text"), 80).alias("short"), T.token_key(F.col("text")).alias("gap_key"))


_KW = f"SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_TOK('text')} AS t FROM documents)"


@query(V.sql("""SELECT doc_id, list(token ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(token) DESC, pos) AS r
  FROM (SELECT doc_id, token, count(*) AS n, min(pos) AS pos FROM kw WHERE length(token) >= 2 GROUP BY 1, 2)) WHERE r <= 12 GROUP BY 1""", kw=_KW))  # fmt: skip
def document_keywords(spark, sf_dir):
    return ingest.keywords(V.table(spark, sf_dir, "documents"))


@query(V.sql("SELECT doc_id, kb_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, file_hash ORDER BY doc_id) AS n FROM document_v d WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM document_v s WHERE s.doc_id % 4 = 0 AND s.kb_id = d.kb_id AND s.file_hash = d.file_hash)) WHERE n = 1", "document_v"))
def ingest_dedup(spark, sf_dir):
    """New documents of a batch against those stored."""
    d = V.document_v(spark, sf_dir)
    return ingest.new_documents(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0")).select("doc_id", "kb_id", "file_hash")


@query(V.sql("SELECT reason, doc_id, n FROM (SELECT 'hash' AS reason, min(doc_id) AS doc_id, count(*) AS n FROM document_v GROUP BY file_hash UNION ALL SELECT 'title', min(doc_id), count(*) FROM document_v GROUP BY kb_id, lower(trim(title))) WHERE n > 1", "document_v"))
def duplicate_groups(spark, sf_dir):
    return governance.duplicate_groups(V.document_v(spark, sf_dir))


_HEALTH = f"""SELECT 'expired' AS issue_type, 'high' AS severity, doc_id FROM live WHERE ex UNION ALL SELECT 'expiring_soon', 'medium', doc_id FROM live WHERE NOT ex AND left_days BETWEEN 1 AND 90
  UNION ALL SELECT 'no_owner', 'medium', doc_id FROM live WHERE trim(owner) = '' UNION ALL SELECT 'stale', 'low', doc_id FROM live WHERE old_days > 365 AND governance_status = 'valid'
  UNION ALL SELECT 'parse_failed', 'high', doc_id FROM live WHERE status = 'failed' UNION ALL SELECT 'empty_summary', 'low', doc_id FROM live WHERE trim(summary) = ''
  UNION ALL SELECT 'duplicate', 'medium', doc_id FROM (SELECT min(doc_id) AS doc_id, count(*) AS n FROM live GROUP BY file_hash UNION ALL SELECT min(doc_id), count(*) FROM live GROUP BY kb_id, lower(trim(title))) WHERE n > 1"""
_LIVE = f"SELECT *, expire_date <= {V.AS_OF} AND governance_status <> 'deprecated' AS ex, floor((epoch_us(expire_date) - epoch_us({V.AS_OF})) / 86400e6) AS left_days, floor((epoch_us({V.AS_OF}) - epoch_us(updated_at)) / 86400e6) AS old_days FROM document_v WHERE NOT is_deleted"


@query(V.sql("SELECT * FROM h", "document_v", live=_LIVE, h=_HEALTH))
def health_issues(spark, sf_dir):
    return governance.health_issues(V.document_v(spark, sf_dir), V.as_of())


@query(V.sql("SELECT (SELECT count(*) FROM live) AS total_docs, count(*) AS n_issues, round(greatest(0.0, 100.0 - sum(CASE severity WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END)::double / (SELECT count(*) FROM live) * 12.0), 1) AS score FROM h", "document_v", live=_LIVE, h=_HEALTH))
def health_score(spark, sf_dir):
    d = V.document_v(spark, sf_dir)
    return governance.health_score(governance.health_issues(d, V.as_of()), d)


@query(V.sql("SELECT kb_id, count(*) FILTER (NOT is_deleted) AS n_docs, count(*) FILTER (status = 'failed') AS n_failed, count(DISTINCT domain) AS n_domains, count(*) FILTER (governance_status = 'valid') AS n_valid, count(*) FILTER (governance_status = 'need_update') AS n_need_update, count(*) FILTER (governance_status = 'deprecated') AS n_deprecated FROM document_v GROUP BY 1", "document_v"))
def kb_overview(spark, sf_dir):
    status = lambda s: F.count_if(F.col("governance_status") == s).alias(f"n_{s}")
    return V.document_v(spark, sf_dir).groupBy("kb_id").agg(F.count_if(~F.col("is_deleted")).alias("n_docs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.countDistinct("domain").alias("n_domains"), *map(status, ("valid", "need_update", "deprecated")))


@query(V.sql(f"SELECT query_key, n, avg_confidence, no_hits FROM (SELECT coalesce(nullif(list_aggregate(list_sort(list_distinct({_TOK('query')}))[1:5], 'string_agg', ' '), ''), substring(query, 1, 20)) AS query_key, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, bool_and(hit_count = 0) AS no_hits FROM query_log_v WHERE created_at >= timestamp '2024-01-15' - to_days(30) AND intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45) GROUP BY 1) ORDER BY n DESC, avg_confidence, query_key LIMIT 20", "query_log_v"))
def knowledge_gaps(spark, sf_dir):
    return governance.gap_report(V.query_log_v(spark, sf_dir), F.lit("2024-01-15").cast("timestamp"))


@query(V.sql("SELECT intent, count(*) AS n_queries, count(*) FILTER (NOT answered) AS n_unanswered, round(count(*) FILTER (answered) / count(*), 4) AS answer_rate, round(avg(confidence), 4) AS avg_confidence, floor(avg(latency_ms))::bigint AS avg_latency_ms FROM query_log_v GROUP BY 1", "query_log_v"))
def operation_metrics(spark, sf_dir):
    return governance.operation_metrics(V.query_log_v(spark, sf_dir), [F.col("intent")])


@query(V.sql(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK('query')}) AS token FROM query_log_v) WHERE length(token) >= 2 GROUP BY 1 ORDER BY n DESC, token LIMIT 10", "query_log_v"))
def hot_topics(spark, sf_dir):
    return governance.hot_topics(V.query_log_v(spark, sf_dir))


_BOUNDS = ", ".join(map(str, governance.BUCKETS_MS))
_HIST = f"SELECT b AS bucket, CASE WHEN b < {len(governance.BUCKETS_MS)} THEN [{_BOUNDS}][b + 1]::double END AS le, count(latency_ms) AS n FROM (SELECT unnest(range({len(governance.BUCKETS_MS) + 1}))::int AS b) LEFT JOIN query_log_v ON len(list_filter([{_BOUNDS}], lambda x: x < latency_ms)) = b GROUP BY 1, 2"


@query(V.sql("SELECT *, (sum(n) OVER (ORDER BY bucket))::bigint AS cumulative FROM h", "query_log_v", h=_HIST))
def latency_histogram(spark, sf_dir):
    return governance.latency_histogram(V.query_log_v(spark, sf_dir))


@query(V.sql("""SELECT q::double AS q, round(coalesce(lo + (le - lo) * (q * total - (c - n)) / n, lo), 4)::double AS value FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket) AS r FROM (
  SELECT *, coalesce(lag(le) OVER (ORDER BY bucket), 0) AS lo, sum(n) OVER (ORDER BY bucket) AS c, sum(n) OVER () AS total FROM h) CROSS JOIN (SELECT unnest([0.5::double, 0.95::double, 0.99::double]) AS q)
  WHERE c >= q * total AND n > 0) WHERE r = 1""", "query_log_v", h=_HIST))  # fmt: skip
def latency_quantiles(spark, sf_dir):
    return governance.quantiles(governance.latency_histogram(V.query_log_v(spark, sf_dir)))


@query("SELECT event_type, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def event_rates(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("error_rate"), F.round(F.avg("value"), 4).alias("avg_value"))


@query(V.sql("SELECT doc_id, 'removed' AS change FROM document_v WHERE doc_id % 4 <> 0 AND is_deleted UNION ALL SELECT doc_id, 'added' FROM document_v WHERE doc_id % 4 = 0 AND NOT is_deleted", "document_v"))
def version_diff(spark, sf_dir):
    d = V.document_v(spark, sf_dir).select("doc_id", "is_deleted")
    return governance.version_diff(d.where("doc_id % 4 <> 0"), d.where("NOT is_deleted"))


@query(V.sql("SELECT kb_id, doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY updated_at DESC, doc_id) AS place FROM document_v WHERE NOT is_deleted AND governance_status = 'valid' AND (contains(title, 'th') OR contains(title, 'de')) QUALIFY place <= 10", "document_v"))
def document_page(spark, sf_dir):
    """The first page of ten documents of each kb by filters and keyword, newest first."""
    d = V.document_v(spark, sf_dir).where("NOT is_deleted AND governance_status = 'valid'").where(F.col("title").contains("th") | F.col("title").contains("de"))
    at = W.partitionBy("kb_id").orderBy(F.desc("updated_at"), "doc_id")
    return d.select("kb_id", "doc_id", F.row_number().over(at).alias("place")).where("place <= 10")


@query("SELECT conv_id, turn, list(left(text, 400) ORDER BY prior) AS history FROM (SELECT q.conv_id, q.turn, m.turn AS prior, m.text, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY m.turn DESC) AS r FROM conversations q JOIN conversations m ON m.conv_id = q.conv_id AND m.turn < q.turn WHERE q.role = 'user') WHERE r <= 12 GROUP BY 1, 2")
def conversation_history(spark, sf_dir):
    """The last twelve messages before each user turn, cut to 400 characters."""
    m = V.table(spark, sf_dir, "conversations")
    at = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-12, -1)
    return m.withColumn("history", F.collect_list(F.substring("text", 1, 400)).over(at)).where("role = 'user' AND size(history) > 0").select("conv_id", "turn", "history")


@query("SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10")
def dense_vector_search(spark, sf_dir):
    """The ten nearest vectors of the query set: every id divisible by 50, against all rows."""
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.dense_search(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query(V.sql("""SELECT kb_id, n_docs, n_failed, list_filter([CASE WHEN (n_docs - n_failed) / n_docs < 0.99 THEN 'vectors_incomplete' END, CASE WHEN score < 80 THEN 'score_low' END, CASE WHEN n_failed > 0 THEN 'vectors_missing_or_zero' END, CASE WHEN n_domains < 3 THEN 'domain_empty' END], lambda x: x IS NOT NULL) AS reasons,
  len(reasons) = 0 AS passed FROM (SELECT kb_id, count(*) AS n_docs, count(*) FILTER (status = 'failed') AS n_failed, count(DISTINCT domain) AS n_domains, round(greatest(0.0, 100.0 - 6.0 * count(*) FILTER (status = 'failed') / count(*) * 20), 1) AS score FROM document_v GROUP BY 1)""", "document_v"))  # fmt: skip
def release_gate(spark, sf_dir):
    """The gate of each kb; a document that failed to parse counts as one without vector."""
    d = V.document_v(spark, sf_dir).groupBy("kb_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.collect_set("domain").alias("domains"))
    score = F.round(F.greatest(F.lit(0.0), 100.0 - 6.0 * F.col("n_failed") / F.col("n_docs") * 20), 1)
    d = d.select("*", F.col("n_docs").alias("n_chunks"), (F.col("n_docs") - F.col("n_failed")).alias("n_vectors"), F.lit(0).alias("zero_vectors"), score.alias("score"))
    return governance.release_gate(d).select("kb_id", "n_docs", "n_failed", "reasons", "passed")


def _has(c: str, words: list[str]) -> str:
    return " + ".join(f"contains({c}, '{w}')::int" for w in words)


def intent_sql(source: str, keys: str, rules=intents.RULES) -> dict[str, str]:
    """Intent and its confidence of the rows (keys, text) of `source`, as `i5`."""
    names = [n for n, _, _ in rules if n != "chitchat"]
    most, others = f"coalesce(greatest({', '.join(names)}), 0)", ", ".join(n for n, _, _ in rules if n != "case_retrieval")
    return {
        "i0": f"SELECT {keys}, text, lower(text) AS q FROM ({source})",
        "i1": "SELECT *, " + ", ".join(f"CASE WHEN {_has('q', w)} > 0 THEN ({_has('q', w)}) * {intents.HIT}::double + {b}::double END AS {n}" for n, w, b in rules) + " FROM i0",
        "i2": f"SELECT * REPLACE (CASE WHEN length(trim(text)) > {intents.CHITCHAT_LENGTH} AND chitchat > {most} THEN NULL ELSE chitchat END AS chitchat) FROM i1",
        "i3": f"SELECT * REPLACE (CASE WHEN {_has('q', intents.CASE_WORDS)} > 0 AND case_retrieval <= coalesce(greatest({others}), 0) THEN greatest({others}) + 0.1::double ELSE case_retrieval END AS case_retrieval) FROM i2",
        "i4": f"SELECT *, greatest({', '.join(n for n, _, _ in rules)}) AS best FROM i3",
        "i5": f"SELECT {keys}, CASE " + " ".join(f"WHEN {n} = best THEN '{n}'" for n, _, _ in rules) + " ELSE 'unknown' END AS intent, CASE WHEN best IS NULL THEN 0.3::double ELSE round(least(0.95::double, 0.45::double + best), 3) END AS intent_confidence FROM i4",
    }


_INTENTS = intent_sql("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'", "conv_id, turn")
_PLANS = ", ".join(f"('{k}', {list(d)!r}::varchar[], '{s}', {n}, {t}::double, {v}::double, {b}::double)" for k, (d, s, n, t, v, b) in intents.PLANS.items())


@query(V.sql(f"SELECT i5.*, domains, strategy, top_k, threshold, vector_weight, bm25_weight, intent <> 'chitchat' AS need_retrieval FROM i5 JOIN (VALUES {_PLANS}) p(intent, domains, strategy, top_k, threshold, vector_weight, bm25_weight) USING (intent)", **_INTENTS))
def retrieval_plans(spark, sf_dir):
    """Intent, domains and retrieval plan of every user turn."""
    m = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    return intents.planned(intents.classified(m, query="text")).drop("role", "text")


@query("SELECT item_id AS query_id, unnest(p[1:3]) AS sub_query, unnest(range(1, least(len(p), 3) + 1))::int AS n FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[?？;；]|以及|还有'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 6) AS p FROM (SELECT item_id, replace(text, ',', '?') AS text FROM benchmark)) WHERE len(p) > 1")
def sub_queries(spark, sf_dir):
    """Parts of the benchmark items; their commas stand for question marks."""
    q = V.query_v(spark, sf_dir)
    return intents.sub_queries(q.withColumn("query", F.replace("query", F.lit(","), F.lit("?"))))


def _contexts(spark, sf_dir):
    d = V.document_v(spark, sf_dir)
    c = written(_hybrid(spark, sf_dir).where("rank <= 6").select("query_id", "doc_id", F.col("fusion_score").alias("final_score"), "rank"), "contexts")
    d, no = fetched(d.select("doc_id", "text", "title", "governance_status", "domain"), c, "doc_id", "context-texts"), F.lit("")
    return c.join(d.select("doc_id", F.col("text").alias("content"), "title", "governance_status", no.alias("standard_code"), F.col("domain").alias("section_path"), no.alias("clause_no"), F.lit(0).alias("page_no")), "doc_id", "left")


_ENDS = "。；！？;!?."
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_CONTEXT = {
    "fused": _FUSED,
    "c0": "SELECT query_id, doc_id, fusion_score AS final_score, f.rank, governance_status, '《' || title || '》 | 章节：' || domain || CASE governance_status WHEN 'deprecated' THEN ' | ⚠已废弃，仅供参考' WHEN 'need_update' THEN ' | ⚠待更新' ELSE '' END AS head, "
    + _STRIP("text") + " AS body FROM fused f JOIN document_v USING (doc_id) WHERE f.rank <= 6",
    "c1": "SELECT * FROM c0 WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY query_id, substring(body, 1, 80), length(body) // 50 ORDER BY rank, doc_id) = 1",
    "c2": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS p FROM c1",
    "fold": """SELECT query_id, 0::bigint AS p, NULL::bigint AS doc_id, 0::bigint AS rank, 8000::bigint AS budget, '' AS block, false AS done FROM c2 WHERE p = 1
      UNION ALL SELECT query_id, p, doc_id, rank, budget - length(block), block, budget - length(block) <= 200 FROM (SELECT query_id, p, doc_id, rank, budget, CASE WHEN length(b) > budget THEN substring(b, 1, budget) || '…' ELSE b END AS block
        FROM (SELECT c2.query_id, c2.p, c2.doc_id, c2.rank, fold.budget, '[' || c2.p || '] ' || head || chr(10) || body AS b FROM fold JOIN c2 ON c2.query_id = fold.query_id AND c2.p = fold.p + 1 WHERE NOT fold.done) WHERE NOT (length(b) > budget AND budget < 300))""",
    "blocks": "SELECT query_id, p::int AS index_no, doc_id, rank, block FROM fold WHERE p > 0",
}
_ANSWER = {
    "e0": "SELECT query_id, index_no, " + _STRIP("regexp_replace(regexp_replace(block[position(chr(10) in block) + 1:], '【[^】]{0,120}】', ' ', 'g'), '\\s+', ' ', 'g')") + " AS body FROM blocks",
    "e1": f"SELECT query_id, index_no, body, list_filter(list_transform(regexp_extract_all(body, '[^{_ENDS}]+[{_ENDS}]?'), lambda s: trim(s)), lambda s: length(s) > 10) AS s FROM e0 WHERE length(body) >= 10",
    "e2": "SELECT query_id, index_no, len(s) > 0 AS whole, unnest(CASE WHEN len(s) > 0 THEN s ELSE [body[1:200]] END) AS s, unnest(range(1, greatest(len(s), 1) + 1)) AS pos FROM e1",
    "e3": f"SELECT query_id, index_no, s, pos, CASE WHEN whole THEN round(len(list_intersect(list_distinct({_TOK('query')}), {_TOK('s')})) / greatest(len(list_distinct({_TOK('query')})), 1) + CASE WHEN regexp_matches(s, '{answers.MEASURE}') THEN 0.12::double ELSE 0.0::double END, 6) ELSE 0.0 END AS score FROM e2 JOIN query_v USING (query_id)",
    "e4": "SELECT * FROM e3 QUALIFY row_number() OVER (PARTITION BY query_id, index_no ORDER BY score DESC, pos) = 1",
    "e5": "SELECT * FROM e4 QUALIFY row_number() OVER (PARTITION BY query_id, substring(s, 1, 40) ORDER BY score DESC, index_no) = 1",
    "e6": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_no) AS r FROM e5 QUALIFY r <= 4",
    "e7": "SELECT query_id, string_agg('- ' || CASE WHEN length(s) > 320 THEN s[1:320] || '…' ELSE s END || ' [' || index_no || ']', chr(10) ORDER BY r) AS lines FROM e6 GROUP BY 1",
    "ans": f"SELECT q.query_id, query, coalesce('{answers.ANSWER_HEAD}' || chr(10) || lines || chr(10) || '{answers.ANSWER_NOTE}', '{answers.NO_CONTEXT}') AS answer FROM query_v q LEFT JOIN e7 USING (query_id)",
    "ctx": "SELECT b.query_id, b.doc_id, b.index_no AS rank, final_score, governance_status FROM blocks b JOIN c2 ON c2.query_id = b.query_id AND c2.p = b.index_no",
}


@query(V.sql("SELECT * FROM blocks", "document_v", "query_v", **_BM25, **_VEC, **_CONTEXT).replace("WITH", "WITH RECURSIVE", 1))
def context_blocks(spark, sf_dir):
    """Numbered context blocks of each benchmark item, without near repeats, within the budget."""
    return answers.context_blocks(_contexts(spark, sf_dir))


def _answers(spark, sf_dir):
    """Contexts of the items as used, numbered as the answer marks them, and the extractive answers."""
    c = _contexts(spark, sf_dir)
    b = answers.context_blocks(c)
    used = b.join(c.select("query_id", "doc_id", "final_score", "governance_status"), ["query_id", "doc_id"]).drop("rank", "block").withColumnRenamed("index_no", "rank")
    return used, answers.extracted(V.query_v(spark, sf_dir), b, _ENDS)


@query(V.sql("SELECT * FROM ans", "document_v", "query_v", **_BM25, **_VEC, **_CONTEXT, **_ANSWER).replace("WITH", "WITH RECURSIVE", 1))
def extractive_answers(spark, sf_dir):
    """The answer of each benchmark item, made of sentences of its contexts."""
    return _answers(spark, sf_dir)[1]


_SURE = f"""SELECT query_id, coalesce(round(least(1.0::double, (0.34 * least(1.0, 0.6 * top + 0.4 * mean) + 0.14 * least(1.0, n / 4.0) + 0.14 * least(1.0, docs / 3.0)
  + 0.24 * least(1.0, len(list_distinct(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1))) / greatest(1, least(3, n))) + 0.14 * len(list_intersect(list_distinct({_TOK('query')}), {_TOK('answer')})) / greatest(len(list_distinct({_TOK('query')})), 1))
  * CASE WHEN old THEN 0.75 ELSE 1.0 END * CASE WHEN contains(answer, '未提供') OR contains(answer, '知识库未') THEN 0.6 ELSE 1.0 END), 4), 0)::double AS confidence FROM ans LEFT JOIN (SELECT query_id, max(final_score) AS top, avg(final_score) AS mean, count(*) AS n, count(DISTINCT doc_id) AS docs, bool_or(governance_status = 'deprecated') AS old FROM ctx GROUP BY 1) USING (query_id)"""


@query(V.sql("SELECT query_id, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS level, confidence < 0.45 AS need_review FROM sure", "document_v", "query_v", **_BM25, **_VEC, **_CONTEXT, **_ANSWER, sure=_SURE).replace("WITH", "WITH RECURSIVE", 1))
def answer_confidence(spark, sf_dir):
    """Confidence in the extractive answers from their contexts and marks."""
    return intents.confidence(*_answers(spark, sf_dir))


@query(V.sql("SELECT ctx.query_id, doc_id, rank FROM ctx JOIN ans USING (query_id) WHERE contains(answer, '[' || rank || ']') OR NOT regexp_matches(answer, '\\[\\d{1,2}\\]')", "document_v", "query_v", **_BM25, **_VEC, **_CONTEXT, **_ANSWER).replace("WITH", "WITH RECURSIVE", 1))
def answer_citations(spark, sf_dir):
    """The contexts that the extractive answers mark."""
    return intents.citations(*_answers(spark, sf_dir)).select("query_id", "doc_id", "rank")


@query(V.sql(f"SELECT query_id, doc_id, f.rank, fusion_score, title, CASE WHEN length(text) > 500 THEN text[1:500] || '…' ELSE text END AS content, list_sort(list_intersect(list_distinct({_TOK('query')}), {_TOK('text')})) AS matched_terms FROM fused f JOIN query_v USING (query_id) LEFT JOIN document_v USING (doc_id)", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED))
def search_results(spark, sf_dir):
    """Fused candidates as a search page shows them."""
    return answers.search_rows(_hybrid(spark, sf_dir), V.query_v(spark, sf_dir), V.document_v(spark, sf_dir))


@query(V.sql("SELECT query_id, count(*) AS n, count(*) FILTER (vector_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS n_both, count(*) FILTER (bm25_rank IS NULL) AS n_vector_only, count(*) FILTER (vector_rank IS NULL) AS n_bm25_only, max(fusion_score) AS best, max(fusion_score) < 0.3 AS weak FROM fused GROUP BY 1", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED))
def search_signals(spark, sf_dir):
    """Which channels found the candidates of each item."""
    return answers.explained(_hybrid(spark, sf_dir))


@query("SELECT conv_id, turn, array_to_string(list_filter([trim(text), CASE WHEN contains(text, 'the') THEN 'article determiner' ELSE '' END], lambda x: x <> ''), ' ') AS rewritten FROM conversations WHERE role = 'user'")
def rewritten_queries(spark, sf_dir):
    """User turns with the synonyms of a term that occurs in these texts."""
    m = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    q = m.select("conv_id", "turn", F.col("text").alias("query"), *[F.lit(None).cast("string").alias(c) for c in ("project_type", "region", "last_user")])
    return answers.rewritten(q, {"the": "article determiner"}).select("conv_id", "turn", "rewritten")


@query(f"SELECT query_key, 'gap_fill' AS task_type, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS priority FROM ({ORACLES['knowledge_gaps']})")
def gap_tasks(spark, sf_dir):
    """A task for each gap found."""
    return intents.gap_tasks(knowledge_gaps(spark, sf_dir))


@query(V.sql("SELECT doc_id, title, total, ceil(total / 20)::bigint AS pages FROM (SELECT doc_id, title, updated_at, count(*) OVER () AS total FROM document_v WHERE NOT is_deleted AND governance_status = 'valid' AND contains(lower(title), 'an')) ORDER BY updated_at DESC, doc_id LIMIT 20 OFFSET 20", "document_v"))
def document_list_page(spark, sf_dir):
    """The second page of the valid documents with a keyword in the title, newest first."""
    found = reports.search_documents(V.document_v(spark, sf_dir), "an", governance_status="valid")
    return reports.page_of(found.select("doc_id", "title", "updated_at"), [F.desc("updated_at"), F.col("doc_id")], 2).drop("updated_at")


@query(V.sql("SELECT conv_id, turn, intent, hit_count, answered FROM query_log_v WHERE intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45)", "query_log_v"))
def gap_triggers(spark, sf_dir):
    """Log rows that start a knowledge gap."""
    log = V.query_log_v(spark, sf_dir).drop("answered").withColumn("rejected", F.lit(False))
    return reports.log_rows(log).where("is_gap").select("conv_id", "turn", "intent", "hit_count", "answered")


_RUNS = {
    "r": "SELECT created_at::date AS day, round(count_if(answered) / count(*), 4) AS rate FROM query_log_v GROUP BY 1",
    "l": "SELECT * FROM r ORDER BY day DESC LIMIT 10",
}


@query(V.sql("SELECT count(*) AS n_runs, arg_min(rate, day) AS first_value, arg_max(rate, day) AS latest_value, round(arg_max(rate, day) - arg_min(rate, day), 4) AS delta, count(*) FILTER (round(rate - 0.75, 4) < -0.02) AS n_regressed, count(*) FILTER (round(rate - 0.75, 4) > 0.02) AS n_improved FROM l", "query_log_v", **_RUNS))
def answer_rate_trend(spark, sf_dir):
    """The answer rate of the ten latest days against a baseline."""
    days = governance.operation_metrics(V.query_log_v(spark, sf_dir), [F.to_date("created_at").alias("day")])
    return reports.trend(days.select("day", "answer_rate"), "answer_rate", "day", 0.75)


@query(V.sql("""SELECT kb_id, count(DISTINCT d.doc_id) AS n_docs, count(severity) AS n_issues, count(*) FILTER (severity = 'high') AS n_high,
    round(greatest(0.0, 100.0 - coalesce(sum(CASE severity WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 WHEN 'low' THEN 1.0 END), 0)::double / count(DISTINCT d.doc_id) * 12.0), 1) AS score
    FROM (SELECT doc_id, kb_id FROM live) d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY kb_id""", "document_v", live=_LIVE, h=_HEALTH))
def kb_reports(spark, sf_dir):
    """Health of each knowledge base."""
    return reports.kb_reports(V.document_v(spark, sf_dir), V.as_of())


@query(V.sql("SELECT doc_id, 'missing_standard_code' AS issue_type, 'medium' AS severity FROM document_v WHERE domain = 'standard' AND trim(CASE WHEN owner = 'u1' THEN '' ELSE 'GB' || doc_id END) = ''", "document_v"))
def missing_codes(spark, sf_dir):
    """Documents of the standard domain without code; those of one owner play documents without."""
    code = F.when(F.col("owner") == "u1", "").otherwise(F.concat(F.lit("GB"), F.col("doc_id").cast("string")))
    return quality.missing_codes(V.document_v(spark, sf_dir).withColumn("standard_code", code))


@query(V.sql("SELECT d.domain, count(v.doc_id) AS n_chunks, CASE WHEN count(v.doc_id) = 0 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT unnest(['standard', 'case', 'enterprise', 'project']) AS domain) d LEFT JOIN document_v v USING (domain) GROUP BY 1", "document_v"))
def domain_coverage(spark, sf_dir):
    """How many documents each domain has, one without any included; the threshold is so high that all are listed."""
    return quality.sparse_domains(V.document_v(spark, sf_dir), ("standard", "case", "enterprise", "project"), 1 << 40)


@query(V.sql("SELECT item_id AS query_id, count(doc_id) AS n_relevant, count(doc_id) = 0 AS negative FROM benchmark LEFT JOIN gold ON gold.query_id = item_id GROUP BY 1", gold=_GOLD))
def golden_summary(spark, sf_dir):
    """Relevant documents of each benchmark item; items without are negatives."""
    g = _golden(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant"))
    return lists.golden_summary(V.query_v(spark, sf_dir).join(g, "query_id", "left")).withColumn("n_relevant", F.col("n_relevant").cast("long"))


_RANKED = "SELECT query_id, max(fusion_score) < 0.45 OR count(*) FILTER (fusion_score >= 0.45 * 0.75) < 2 AS rejected FROM (SELECT * FROM fused WHERE rank <= 6) GROUP BY 1"
_RATES = """SELECT count(*) FILTER (NOT negative) AS n_positive, count(*) FILTER (negative) AS n_negative, round(coalesce(avg((coalesce(recall_5, 0) > 0)::int) FILTER (NOT negative), 0), 4) AS hit_rate,
  round(coalesce(avg((coalesce(recall_5, 0) >= 1)::int) FILTER (NOT negative), 0), 4) AS full_hit_rate, round(coalesce(avg(coalesce(rejected, false)::int) FILTER (NOT negative), 0), 4) AS below_floor_rate,
  round(coalesce(avg(coalesce(rejected, true)::int) FILTER (negative), 0), 4) AS correct_rejection_rate FROM (SELECT query_id, query_id NOT IN (SELECT query_id FROM gold) AS negative FROM query_v) LEFT JOIN m USING (query_id) LEFT JOIN floor USING (query_id)"""


@query(V.sql(_RATES, "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED, gold=_GOLD, m=_METRICS, floor=_RANKED))
def evaluation_rates(spark, sf_dir):
    """Hit, floor and rejection rates of the fused lists over all benchmark items."""
    found, gold = _hybrid(spark, sf_dir), _golden(spark, sf_dir)
    g = V.query_v(spark, sf_dir).join(gold.select("query_id", F.lit(True).alias("has")).distinct(), "query_id", "left").select("query_id", F.col("has").isNull().alias("negative"))
    ranked = search.relevance_floor(found.where("rank <= 6").withColumnRenamed("fusion_score", "final_score"))
    return evaluate.run_rates(g, evaluate.ranking_metrics(found.select("query_id", "doc_id", "rank"), gold), ranked)


@query(V.sql("SELECT gold.query_id, 'isolated_query' AS issue_type, 'high' AS severity FROM (SELECT DISTINCT query_id FROM gold) gold WHERE query_id NOT IN (SELECT query_id FROM fused WHERE fusion_score >= 0.9)", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED, gold=_GOLD))
def isolated_queries(spark, sf_dir):
    """Items with relevant documents but without any strong candidate."""
    return quality.isolated_queries(_golden(spark, sf_dir), _hybrid(spark, sf_dir).where("fusion_score >= 0.9"))


@query(V.sql("SELECT issue_type, severity, doc_id FROM h ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, issue_type, doc_id LIMIT 200", "document_v", live=_LIVE, h=_HEALTH))
def inspection_issues(spark, sf_dir):
    """The 200 gravest issues, as a report keeps them."""
    return quality.inspection(health_issues(spark, sf_dir), 1)[1]


@query(V.sql("SELECT issue_type, n, round(n / sum(n) OVER (), 4)::double AS share FROM (SELECT issue_type, count(*) AS n FROM h GROUP BY 1)", "document_v", live=_LIVE, h=_HEALTH))
def issue_share(spark, sf_dir):
    """Share of each kind of issue over the reports of all knowledge bases."""
    i = health_issues(spark, sf_dir).join(V.document_v(spark, sf_dir).select("doc_id", "kb_id"), "doc_id").groupBy("kb_id", "issue_type").agg(F.count("*").alias("n"))
    return lists.issue_share(i.groupBy("kb_id").agg(F.map_from_entries(F.collect_list(F.struct("issue_type", "n"))).alias("issue_counts")))


@query(V.sql("SELECT kb_id, 2 AS version_no, doc_id FROM document_v WHERE NOT is_deleted", "document_v"))
def version_members(spark, sf_dir):
    """Members of a second checkpoint of each knowledge base."""
    d = V.document_v(spark, sf_dir)
    return versions.checkpoint(d, d.select("kb_id", F.lit(1).alias("version_no")).distinct())[1]


@query("SELECT conv_id, turn, role, text FROM conversations")
def conversation_messages(spark, sf_dir):
    """Messages of all conversations in order."""
    return lists.listed(V.table(spark, sf_dir, "conversations"), "turn").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text")


_NEAR = "SELECT doc_id, neighbour, cosine, 'duplicate_chunk' AS issue_type, 'high' AS severity FROM (SELECT a.id AS doc_id, b.id AS neighbour, round(sum(a.v * b.v), 6) AS cosine FROM dv a JOIN dv b ON a.bucket = b.bucket AND a.id <> b.id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.v * b.v), 6) DESC, b.id) = 1) WHERE cosine >= 0.92 AND neighbour > doc_id"


@query(V.sql(_NEAR, "document_v", **{k: _VEC[k] for k in ("df0", "dg", "db", "dv")}))
def near_duplicate_vectors(spark, sf_dir):
    """Documents whose nearest document by hashed text vectors is nearly the same."""
    d = hashed(V.table(spark, sf_dir, "documents"), "doc_id")
    return neighbours.near_duplicate_issues(neighbours.nearest_similar(d, "doc_id", "vector"), "doc_id")


@query("SELECT vec_id, cosine, 'orphan_chunk' AS issue_type, 'medium' AS severity FROM (SELECT a.vec_id, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) WHERE cosine < 0.35")
def orphan_vectors(spark, sf_dir):
    """Vectors that are like no other; these are random, so the threshold is higher than for texts."""
    return neighbours.orphans(V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.35)


_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_CLEAN = lambda c: _TRIM(f"regexp_replace(regexp_replace(regexp_replace(translate({c}, chr(160) || chr(12288), '  '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^\\s*[-—]{{0,2}}\\s*\\d{{1,4}}\\s*[-—]{{0,2}}\\s*$', '', 'g')")
_PAGE = {
    "p0": f"SELECT doc_id // 10 AS doc_id, (doc_id % 10 + 1)::int AS page_no, unnest(p) AS raw, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split_regex({_CLEAN('text')}, '\\n\\s*\\n') AS p FROM documents)",
    "p1": f"SELECT doc_id, page_no, k, {_TRIM('raw')} AS text FROM p0",
    "p2": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) - 1 AS pos, CASE WHEN length(text) < 80 THEN regexp_extract(string_split(text, chr(10))[1], '^\\s*(\\d{1,2}(?:\\.\\d{1,3}){0,3})\\s+([^\\n]{2,60})$', 1) ELSE '' END AS clause_no FROM p1 WHERE length(text) >= 2",
}


@query(V.sql("SELECT doc_id, pos, page_no, text, CASE WHEN clause_no <> '' THEN 'heading' ELSE 'paragraph' END AS block_type, clause_no FROM p2", **_PAGE))
def page_blocks(spark, sf_dir):
    """Blocks of documents of ten pages; each text plays a page."""
    i = F.col("doc_id")
    pages = V.table(spark, sf_dir, "documents").select(F.floor(i / 10).alias("doc_id"), (i % 10 + 1).cast("int").alias("page_no"), "text")
    return ingest.page_blocks(pages).select("doc_id", "pos", "page_no", "text", "block_type", "clause_no")


@query()
def ingested_documents(spark, sf_dir):
    """Status, attributes and number of chunks of a batch after ingest from end to end."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kb_id"), "text")
    old = V.document_v(spark, sf_dir).where("doc_id % 4 = 0").select("kb_id", "file_hash")
    out = ingest.ingested(d.where("doc_id % 4 <> 0"), old, ends=ingest.SENTENCE_ENDS + ".")["documents"]
    return out.select("doc_id", "kb_id", "file_hash", "standard_code", "summary", "keywords", "chunk_count", "status", "error_msg")


_BOARD = """SELECT 'gaps_by_status' AS measure, status AS name, count(*)::double AS value FROM gap GROUP BY status UNION ALL SELECT 'gaps_by_intent', intent, count(*) FROM gap GROUP BY intent
  UNION ALL SELECT 'tasks_by_status', status, count(*) FROM task GROUP BY status UNION ALL SELECT 'gap_total', '', count(*) FROM gap UNION ALL SELECT 'open_gaps', '', count(*) FILTER (status = 'open') FROM gap
  UNION ALL SELECT 'task_total', '', count(*) FROM task UNION ALL SELECT 'pending_tasks', '', count(*) FILTER (status IN ('open', 'processing')) FROM task
  UNION ALL SELECT 'total_queries', '', count(*) FROM late UNION ALL SELECT 'answer_rate', '', round(count(*) FILTER (answered AND hit_count > 0) / count(*), 3) FROM late"""
_WORK = {
    "gap": "SELECT conv_id, turn, intent, CASE WHEN hit_count = 0 THEN 'open' ELSE 'accepted' END AS status FROM query_log_v WHERE intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45)",
    "task": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'processing' ELSE 'done' END AS status FROM documents WHERE doc_id % 7 = 0",
    "late": "SELECT * FROM query_log_v WHERE created_at >= timestamp '2024-01-01 03:00:00'",
}


def _work(spark, sf_dir):
    log = V.query_log_v(spark, sf_dir)
    gaps = log.where("intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45)").select("conv_id", "turn", "intent", F.when(F.col("hit_count") == 0, "open").otherwise("accepted").alias("status"))
    i = F.col("doc_id") % 3
    return log, gaps, V.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id", F.when(i == 0, "open").when(i == 1, "processing").otherwise("done").alias("status"))


@query(V.sql(_BOARD, "query_log_v", **_WORK))
def governance_dashboard(spark, sf_dir):
    """Gaps, tasks and answer rate; the log's weak rows play the gaps, documents without owner the tasks."""
    log, gaps, tasks = _work(spark, sf_dir)
    return governance.dashboard(gaps, tasks, log, F.lit("2024-01-01 03:00:00").cast("timestamp"))


@query(V.sql("""SELECT *, list_filter([CASE WHEN answer_rate < 0.8 AND total_queries > 0 THEN 'fill the knowledge gaps' END, CASE WHEN avg_confidence < 0.5 AND total_queries > 0 THEN 'check chunks, summaries and vectors' END,
    CASE WHEN pending_tasks > 10 THEN 'assign the pending tasks' END, CASE WHEN negative_feedback > 0 THEN 'review the negative feedback' END, CASE WHEN new_docs = 0 THEN 'add documents' END], lambda x: x IS NOT NULL) AS suggestions
  FROM (SELECT count(*) AS total_queries, count(*) FILTER (NOT answered OR hit_count = 0) AS unanswered, round(avg(confidence), 3) AS avg_confidence, floor(avg(latency_ms))::bigint AS avg_latency_ms, round(count(*) FILTER (answered AND hit_count > 0) / count(*), 3) AS answer_rate,
    (SELECT count(*) FROM document_v WHERE updated_at >= timestamp '2024-01-01 03:00:00') AS new_docs, (SELECT count(*) FROM document_v WHERE updated_at >= timestamp '2024-01-01 03:00:00' AND status <> 'failed') AS new_chunks,
    (SELECT count(*) FILTER (status IN ('open', 'processing')) FROM task) AS pending_tasks, (SELECT count(*) FROM late WHERE turn % 5 = 0) AS negative_feedback FROM late)""", "document_v", "query_log_v", **_WORK))  # fmt: skip
def operation_report(spark, sf_dir):
    """The report since a day; documents that were read count as one chunk, each fifth turn is rated badly."""
    log, _, tasks = _work(spark, sf_dir)
    d = V.document_v(spark, sf_dir).withColumn("created_at", F.col("updated_at"))
    feedback = log.select("created_at", F.when(F.col("turn") % 5 == 0, -1).otherwise(1).alias("rating"))
    return governance.operation_report(d, d.where("status <> 'failed'"), log, tasks, feedback, F.lit("2024-01-01 03:00:00").cast("timestamp"))


_FUSED_BY_DOMAIN = _FUSED.replace("THEN 1.12 ELSE 1.0 END, 6)", "THEN 1.12 ELSE 1.0 END * CASE domain WHEN 'case' THEN 1.12 WHEN 'standard' THEN 1.06 ELSE 1.0 END, 6)").replace("b USING (query_id, doc_id)", "b USING (query_id, doc_id) JOIN (SELECT doc_id, domain FROM document_v) USING (doc_id)")


@query(V.sql("SELECT query_id, doc_id, vector_rank, bm25_rank, fusion_score, rank FROM fused", "document_v", "query_v", **_BM25, **_VEC, fused=_FUSED_BY_DOMAIN))
def hybrid_search_by_domain(spark, sf_dir):
    """Fusion of both channels that prefers the domain of cases, then that of standards."""
    d, q = V.document_v(spark, sf_dir), V.query_v(spark, sf_dir)
    prior = d.select("doc_id", search.domain_prior(F.col("domain"), F.array(F.lit("case"), F.lit("standard"))).alias("prior"))
    v, b = written(stored.cosine(spark, sf_dir, q, 20), "found-vectors"), written(stored.bm25(spark, sf_dir, q, 40), "found-terms")
    found = search.fuse(v, b, prior=fetched(prior, v.select("doc_id").unionByName(b.select("doc_id")), "doc_id", "priors"))
    return found.select("query_id", "doc_id", "vector_rank", "bm25_rank", "fusion_score", "rank")


@query(V.sql("SELECT conv_id, turn, 'p' || conv_id % 3 AS project_name, CASE WHEN turn % 2 = 0 THEN 'tunnel' ELSE 'bridge' END AS project_type, CASE WHEN conv_id % 4 = 0 THEN 'general' ELSE 'civil' END AS discipline, CASE WHEN turn % 3 = 0 THEN 'north' ELSE '' END AS region, CASE WHEN turn % 5 = 0 THEN ['own'] ELSE ['kb' || conv_id % 2] END AS kb_ids FROM query_log_v", "query_log_v"))
def inherited_context(spark, sf_dir):
    """User turns with what they leave open taken from their conversation."""
    i, t, no = F.col("conv_id"), F.col("turn"), F.lit("")
    name = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    turns = V.query_log_v(spark, sf_dir).select("conv_id", "turn", no.alias("project_name"), F.when(t % 2 == 0, "tunnel").otherwise(no).alias("project_type"), F.lit("general").alias("discipline"), F.when(t % 3 == 0, "north").otherwise(no).alias("region"), F.when(t % 5 == 0, F.array(F.lit("own"))).alias("kb_ids"))
    own = turns.select("conv_id").distinct().select("conv_id", name("p", 3).alias("project_name"), F.lit("bridge").alias("project_type"), F.when(i % 4 == 0, no).otherwise("civil").alias("discipline"), F.lit(None).cast("string").alias("region"), F.array(name("kb", 2)).alias("kb_ids"))
    return answers.in_context(turns, own)


from corpuslens.plans import access, corpus, retrieval  # noqa: E402, F401  register their queries
