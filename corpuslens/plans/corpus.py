"""Queries of inspection, reports and sketches, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import evaluate, governance, ingest, inspection, intents, quality, sketches
from corpuslens.plans import retrieval
from corpuslens.plans import views as V
from corpuslens.plans.registry import _CLEAN, _GOLD, _TOK, _TRIM, ORACLES, _golden, intent_sql, query

#: Documents play chunks; every 17th has no vector, every 29th one of length 0.
_VECTORS = "SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 0.0 ELSE 1.0 END AS size FROM document_v WHERE doc_id % 17 <> 0"
_HEALTH = {
    "vecs": _VECTORS,
    "health": "SELECT kb_id, count(*) AS checked, count(*) FILTER (size IS NULL) AS missing, count(*) FILTER (size = 0) AS zero, round((count(*) - count(*) FILTER (size IS NULL)) / count(*), 4) AS completeness FROM document_v LEFT JOIN vecs USING (doc_id) WHERE NOT is_deleted GROUP BY 1",
}


def _chunks(spark, sf_dir) -> DataFrame:
    return V.document_v(spark, sf_dir).where("NOT is_deleted")


def _vectors(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    return V.document_v(spark, sf_dir).where(i % 17 != 0).select("doc_id", F.when(i % 29 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), i.cast("double"))).alias("vector"))


def _vector_health(spark, sf_dir) -> DataFrame:
    return inspection.vector_health(_chunks(spark, sf_dir), _vectors(spark, sf_dir), "doc_id")


@query(V.sql("SELECT * FROM health", "document_v", **_HEALTH))
def vector_health(spark, sf_dir):
    """Missing and zero vectors of each knowledge base."""
    return _vector_health(spark, sf_dir)


_CHUNK_ISSUES = {
    **_HEALTH,
    "vi": "SELECT kb_id, 'missing_vector' AS issue_type, 'medium' AS severity FROM document_v LEFT JOIN vecs USING (doc_id) WHERE NOT is_deleted AND size IS NULL UNION ALL SELECT kb_id, 'zero_vector', 'high' FROM document_v JOIN vecs USING (doc_id) WHERE NOT is_deleted AND size = 0 UNION ALL SELECT kb_id, 'oversized_chunk', 'medium' FROM document_v WHERE NOT is_deleted AND length(text) > 6000 UNION ALL SELECT kb_id, 'tiny_chunk', 'low' FROM document_v WHERE NOT is_deleted AND length(text) < 400",
}


def _issues(spark, sf_dir) -> DataFrame:
    c = _chunks(spark, sf_dir)
    bad = quality.vector_issues(c, _vectors(spark, sf_dir), "doc_id", ("kb_id",)).select("kb_id", "issue_type", "severity")
    sized = c.select("doc_id", "kb_id", F.lit(0).alias("seq"), F.length("text").alias("char_count"), F.lit("s").alias("section_path"), F.lit("").alias("clause_no"))
    static = quality.static_issues(sized, 6000, 400, ("kb_id",)).select("kb_id", "issue_type", "severity")
    return bad.unionByName(static)


def _report_sql(rows: str, scope: str, by: str) -> str:
    words = ", ".join(f"CASE WHEN {' OR '.join(f'list_contains(coalesce(kinds, []), {k!r})' for k in names)} THEN '{advice}' END" for names, advice in inspection.ADVICE)
    return f"""SELECT '{scope}' AS scope, kb_id, n_chunks, coalesce(issue_count, 0) AS issue_count, coalesce(high_count, 0) AS high_count, round(greatest(0.0, 100.0 - coalesce(p, 0)::double / greatest(n_chunks, 1) * 20), 1) AS score, coalesce(issue_counts, []) AS issue_counts, CASE WHEN len(advice) > 0 THEN advice ELSE ['keep inspecting'] END AS suggestions FROM (
      SELECT *, list_filter([{words}], lambda x: x IS NOT NULL) AS advice FROM (SELECT {by} AS kb_id, sum(n_chunks)::bigint AS n_chunks FROM (SELECT kb_id, count(*) AS n_chunks FROM document_v WHERE NOT is_deleted GROUP BY 1) GROUP BY 1) s
      LEFT JOIN (SELECT {by} AS kb_id, sum(n)::bigint AS issue_count, coalesce(sum(n) FILTER (issue_type IN {quality.HIGH_TYPES}), 0)::bigint AS high_count, sum(p) AS p, list_sort(list(issue_type || ':' || n)) AS issue_counts, list(issue_type) AS kinds
        FROM (SELECT {by} AS kb_id, issue_type, count(*) AS n, sum(CASE severity WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END) AS p FROM {rows} GROUP BY 1, 2) GROUP BY 1) i USING (kb_id))"""


_REPORTS = _report_sql("vi", "kb", "kb_id") + " UNION ALL " + _report_sql("vi", "all", "''")


@query(V.sql(_REPORTS, "document_v", **_CHUNK_ISSUES))
def inspection_reports(spark, sf_dir):
    """The report of each knowledge base and of all together: score, counts and suggestions."""
    sizes = _chunks(spark, sf_dir).groupBy("kb_id").agg(F.count("*").alias("n_chunks"))
    return inspection.reports(_issues(spark, sf_dir), sizes)


@query(V.sql("""SELECT *, list_filter([CASE WHEN completeness < 0.95 THEN 'vectors_incomplete' END, CASE WHEN score < 80 THEN 'score_low' END, CASE WHEN missing_vectors > 0 THEN 'vectors_missing' END, CASE WHEN zero_vectors > 0 THEN 'vectors_zero' END, CASE WHEN len(empty_domains) > 0 THEN 'domain_empty' END], lambda x: x IS NOT NULL) AS reasons,
    len(reasons) = 0 AS passed, CASE WHEN score IS NULL THEN 'not inspected yet, score unknown' END AS note, bool_and(len(reasons) = 0) OVER () AS overall
  FROM (SELECT k.kb_id, coalesce(d.n, 0) AS total_chunks, coalesce(completeness, 1.0)::double AS completeness, CASE WHEN k.kb_id <> 'src0' THEN r.score END AS score, coalesce(missing, 0) AS missing_vectors, coalesce(zero, 0) AS zero_vectors, list_filter(['standard', 'case', 'enterprise', 'project'], lambda x: NOT list_contains(coalesce(d.doms, []), x)) AS empty_domains
    FROM (SELECT DISTINCT kb_id FROM document_v UNION ALL SELECT 'empty') k LEFT JOIN (SELECT kb_id, count(*) AS n, list(DISTINCT domain) AS doms FROM document_v WHERE NOT is_deleted GROUP BY 1) d USING (kb_id) LEFT JOIN health USING (kb_id) LEFT JOIN (SELECT kb_id, score FROM reps WHERE scope = 'kb') r USING (kb_id))""",
  "document_v", **_CHUNK_ISSUES, reps=_REPORTS))
def release_gates(spark, sf_dir):
    """The gate of each knowledge base from its vectors, latest report and domains, one that was never inspected and one without chunks among them."""
    d = V.document_v(spark, sf_dir)
    kbs = d.select("kb_id").distinct().unionByName(spark.createDataFrame([("empty",)], "kb_id string"))
    latest = inspection_reports(spark, sf_dir).where("scope = 'kb' AND kb_id <> 'src0'")
    return inspection.gates(kbs, _chunks(spark, sf_dir), _vector_health(spark, sf_dir), latest, ("standard", "case", "enterprise", "project"), complete=0.95)


@query(V.sql("SELECT kb_id, count(*) FILTER (NOT is_deleted) AS doc_count, count(*) FILTER (NOT is_deleted AND status <> 'failed') AS chunk_count FROM document_v GROUP BY 1 UNION ALL SELECT 'empty', 0, 0", "document_v"))
def kb_stats(spark, sf_dir):
    """Live documents and chunks of each knowledge base, one without any among them; documents that were read count as one chunk."""
    d = V.document_v(spark, sf_dir)
    return inspection.kb_stats(d.select("kb_id").distinct().unionByName(spark.createDataFrame([("empty",)], "kb_id string")), d, d.where("status <> 'failed'"))


@query(V.sql("SELECT (SELECT count(DISTINCT kb_id) FROM document_v) AS kb_count, count(*) AS doc_count, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, (SELECT list_sort(list(domain || ':' || n)) FROM (SELECT domain, count(*) AS n FROM document_v WHERE NOT is_deleted GROUP BY 1)) AS docs_by_domain, count(*) AS chunk_count, count(*) FILTER (contains(substring(text, 1, 150), 'the')) AS mandatory_count FROM document_v WHERE NOT is_deleted", "document_v"))
def corpus_overview(spark, sf_dir):
    """Counts over the whole corpus; texts with a word of these languages near the start play mandatory ones."""
    d = V.document_v(spark, sf_dir)
    return inspection.overview(d.select("kb_id").distinct(), d, d.withColumn("is_mandatory", F.contains(F.substring("text", 1, 150), F.lit("the"))))


_RECALL = {
    **intent_sql("SELECT item_id AS query_id, text FROM benchmark", "query_id", retrieval.RULES),
    **retrieval._CANDS,
    "gold": _GOLD,
    "recalls": "SELECT g.query_id, coalesce(h.n, 0) / g.n AS recall FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g LEFT JOIN (SELECT query_id, count(*) AS n FROM cands JOIN gold USING (query_id, doc_id) WHERE rank <= 1 GROUP BY 1) h USING (query_id)",
    "by_intent": "SELECT intent, round(avg(round(recall, 4)), 4) AS recall FROM recalls JOIN i5 USING (query_id) GROUP BY 1",
    "routes": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {list(d)!r}::varchar[])" for k, (d, *_) in intents.PLANS.items()) + ") r(intent, domains)",
    "weak": "SELECT domain, list_sort(list(intent)) AS low_intents FROM (SELECT intent, unnest(domains) AS domain FROM by_intent JOIN routes USING (intent) WHERE recall < 0.7) GROUP BY 1",
}


@query(V.sql("SELECT domain, coalesce(n, 0) AS n_chunks, coalesce(low_intents, []) AS low_intents, coalesce(n, 0) <= 3 OR len(coalesce(low_intents, [])) > 0 AS sparse, CASE WHEN coalesce(n, 0) = 0 THEN 'high' WHEN n <= 3 THEN 'medium' END AS severity FROM (SELECT unnest(['standard', 'case', 'enterprise', 'project']) AS domain) LEFT JOIN (SELECT domain, count(*) AS n FROM document_v WHERE NOT is_deleted GROUP BY 1) USING (domain) LEFT JOIN weak USING (domain)", "document_v", **_RECALL))
def coverage_gaps(spark, sf_dir):
    """Chunks of each domain and the intents of low first-place recall that are routed to it."""
    first = evaluate.ranking_metrics(retrieval.candidates(spark, sf_dir).select("query_id", "doc_id", "rank"), _golden(spark, sf_dir), (1,)).withColumnRenamed("recall_1", "recall_5")
    recall = quality.intent_recall(first, retrieval.planned_items(spark, sf_dir))
    routes = spark.createDataFrame([(k, list(d)) for k, (d, *_) in intents.PLANS.items()], "intent string, domains array<string>")
    return inspection.coverage(_chunks(spark, sf_dir), recall, routes, ("standard", "case", "enterprise", "project"))


_KEY = f"coalesce(nullif(list_aggregate(list_sort(list_distinct({_TOK('query')}))[1:6], 'string_agg', ' '), ''), substring(sha256(lower(trim(query))), 1, 32))"
_CAUGHT = {
    "weaklog": f"SELECT {_KEY} AS query_key, query, intent, [intent, 'any'] AS domains, created_at, conv_id, turn FROM query_log_v WHERE intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45)",
    "caught": "SELECT query_key, count(*) AS n, max(created_at) AS last_asked_at, 'open' AS status, arg_max(query, {c: created_at, q: query, i: intent}) AS query, arg_max(intent, {c: created_at, q: query, i: intent}) AS intent, arg_max(domains, {c: created_at, q: query, i: intent}) AS domains FROM weaklog GROUP BY 1",
}


def _caught(spark, sf_dir) -> DataFrame:
    log = V.query_log_v(spark, sf_dir).where("intent <> 'chitchat' AND (hit_count = 0 OR confidence < 0.45)").withColumn("domains", F.array("intent", F.lit("any")))
    none = spark.createDataFrame([], "query_key string, n long, last_asked_at timestamp, status string, query string, intent string, domains array<string>")
    return governance.capture_gaps(none, log, ("query", "intent", "domains"))


@query(V.sql("SELECT query_key, n, last_asked_at, status, query, intent, domains FROM caught", "query_log_v", **_CAUGHT))
def captured_gaps(spark, sf_dir):
    """Gaps of the log's weak rows with the latest wording, intent and domains of each."""
    return _caught(spark, sf_dir)


@query(V.sql(f"SELECT query_key, 'gap_fill' AS task_type, 'fill: ' || substring(query, 1, 30) AS title, 'asked ' || n || ' times (intent ' || intent || '): ' || query || '; add to: ' || array_to_string(domains, ', ') AS description, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS priority, {V.AS_OF} + to_days(14) AS due_date FROM caught WHERE intent <> 'unknown'", "query_log_v", **_CAUGHT))
def accepted_gap_tasks(spark, sf_dir):
    """Tasks of the captured gaps, those of one intent having theirs already."""
    g = _caught(spark, sf_dir)
    return inspection.accepted_gaps(g, V.as_of(), g.where("intent = 'unknown'"))


@query(V.sql("SELECT day, sum((error)::int)::bigint AS n_errors, count(*) AS n, round(avg(error::int), 4) AS error_rate, count(*) FILTER (cache = 'hit') AS hits, count(cache) AS lookups, round(coalesce(count(*) FILTER (cache = 'hit') / nullif(count(cache), 0), 0), 4)::double AS hit_rate FROM (SELECT ts::date AS day, event_type = 'error' AS error, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'miss' END AS cache FROM events) GROUP BY 1"))
def request_rates(spark, sf_dir):
    """Errors and cache hits by day; clicks play hits, views misses."""
    e = V.table(spark, sf_dir, "events")
    log = e.select(F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "view", "miss").alias("cache"))
    return inspection.request_rates(log, [F.col("day")])


_G = sketches._base(sketches.ACCURACY)
_SKETCH = {
    "b0": f"SELECT date_trunc('hour', ts) AS hour, event_type, value, CASE WHEN value > 0 THEN ceil(round(ln(value::double) / ln({_G!r}::double), 9))::int ELSE {sketches.ZERO} END AS bucket FROM events WHERE value IS NOT NULL",
    "lv": "SELECT date_trunc('day', hour) AS day, event_type, 0 AS level, bucket FROM b0 UNION ALL SELECT date_trunc('day', hour), NULL, 1, bucket FROM b0 UNION ALL SELECT NULL, NULL, 2, bucket FROM b0",
    "sk": "SELECT day, event_type, level, bucket, count(*) AS n FROM lv GROUP BY ALL",
    "cum": "SELECT *, sum(n) OVER (PARTITION BY day, event_type, level ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY day, event_type, level) AS total FROM sk",
}


@query(V.sql("SELECT day, event_type, level, any_value(total)::bigint AS n, " + ", ".join(f"round(min(CASE WHEN upto >= ceil({q} * total) THEN CASE WHEN bucket = {sketches.ZERO} THEN 0.0 ELSE 2 * pow({_G!r}::double, bucket) / ({_G!r}::double + 1) END END), 6) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM cum GROUP BY 1, 2, 3", **_SKETCH))
def latency_quantiles_by_day(spark, sf_dir):
    """Quantiles by day and kind, by day, and over all, merged from sketches by the hour; the tables' values play latencies."""
    e = V.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = sketches.sketch(e, "value", [F.col("hour"), F.col("event_type")]).withColumn("day", F.date_trunc("day", "hour"))
    q = sketches.quantiles(sketches.merged(hourly, ["day", "event_type"], rollup=True), ["day", "event_type", "level"])
    return q.select("day", "event_type", "level", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


_SINCE = "timestamp '2024-01-01 03:00:00'"


@query(V.sql(f"""SELECT 'gaps_by_status' AS measure, 'open' AS name, count(*)::double AS value FROM caught UNION ALL SELECT 'gaps_by_intent', intent, count(*) FROM caught GROUP BY intent UNION ALL SELECT 'tasks_by_status', 'open', count(*) FROM caught WHERE intent = 'unknown'
  UNION ALL SELECT 'gap_total', '', count(*) FROM caught UNION ALL SELECT 'open_gaps', '', count(*) FROM caught UNION ALL SELECT 'task_total', '', count(*) FROM caught WHERE intent = 'unknown' UNION ALL SELECT 'pending_tasks', '', count(*) FROM caught WHERE intent = 'unknown'
  UNION ALL SELECT 'total_queries', '', count(*) FROM query_log_v WHERE created_at >= {_SINCE} UNION ALL SELECT 'answer_rate', '', round(count(*) FILTER (answered AND hit_count > 0) / count(*), 3) FROM query_log_v WHERE created_at >= {_SINCE}
  UNION ALL SELECT 'docs_by_domain', domain, count(*) FROM document_v WHERE NOT is_deleted GROUP BY domain UNION ALL SELECT 'top_gaps', query_key, n FROM (SELECT * FROM caught ORDER BY n DESC, last_asked_at DESC, query_key LIMIT 10)""", "document_v", "query_log_v", **_CAUGHT))  # fmt: skip
def governance_board(spark, sf_dir):
    """The dashboard over captured gaps, with documents by domain and the gaps asked most."""
    g = _caught(spark, sf_dir)
    tasks = g.where("intent = 'unknown'").select(F.lit("open").alias("status"))
    return governance.dashboard(g, tasks, V.query_log_v(spark, sf_dir), F.lit("2024-01-01 03:00:00").cast("timestamp"), V.document_v(spark, sf_dir))


@query(V.sql(f"""SELECT (SELECT list(token || ':' || n ORDER BY n DESC, token) FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK('query')}) AS token FROM query_log_v WHERE created_at >= {_SINCE}) WHERE length(token) >= 2 GROUP BY 1 ORDER BY n DESC, token LIMIT 10)) AS hot_topics,
  (SELECT list(query_key || ':' || n ORDER BY n DESC, query_key) FROM (SELECT query_key, n FROM ({ORACLES['knowledge_gaps']}) ORDER BY n DESC, avg_confidence, query_key LIMIT 10)) AS gaps""", "query_log_v"))  # fmt: skip
def operation_topics(spark, sf_dir):
    """Hot topics and gaps as the operation report lists them."""
    log = V.query_log_v(spark, sf_dir)
    return governance.operation_topics(log, F.lit("2024-01-01 03:00:00").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))


@query("SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value::double, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def exact_latency_quantiles(spark, sf_dir):
    """Quantiles of each kind by interpolation between values, for those who need no sketch."""
    q = sketches.exact_quantiles(V.table(spark, sf_dir, "events"), "value", [F.col("event_type")])
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def chunk_sql(source: str, size: int = 600, overlap: int = 100, least: int = 40, ends: str = ingest.SENTENCE_ENDS + ".") -> dict[str, str]:
    """Chunks of the rows (doc_id, text) of `source`, as `chunks`: blocks, sections, groups of blocks, packs of sentences. The two
    greedy passes go from border to border over running lengths."""
    clause = lambda c: f"regexp_extract(trim(substring({c}, 1, 60)), '{T.CLAUSE}', 1)"
    levels = range(1, 7)
    at = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    open_ = lambda n: f"CASE WHEN p{n} > greatest(-1, {', '.join(f'coalesce(p{m}, -1)' for m in range(1, n)) or '-1'}) THEN t{n} END"
    return {
        "k_paras": f"SELECT doc_id, unnest(p) AS raw, unnest(range(len(p))) AS pos FROM (SELECT doc_id, string_split_regex({_CLEAN('text')}, '\\n\\s*\\n') AS p FROM ({source}))",
        "k_first": f"SELECT doc_id, pos, text, string_split(text, chr(10))[1] AS line FROM (SELECT doc_id, pos, {_TRIM('raw')} AS text FROM k_paras) WHERE text <> ''",
        "k_marks": "SELECT doc_id, pos, text, regexp_extract(line, '^(#{1,6})\\s+(.*)$', 1) AS mark, regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2) AS title, regexp_extract(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,3}){0,3})\\s+(\\S[^\\n]{0,60})$', 1) AS num, regexp_extract(line, '^\\s*(\\d{1,2}(?:\\.\\d{1,3}){0,3})\\s+(\\S[^\\n]{0,60})$', 2) AS num_title FROM k_first",
        "k_blocks": "SELECT doc_id, pos, text, CASE WHEN mark <> '' AND length(text) < 200 THEN length(mark) WHEN num <> '' AND length(text) < 90 THEN len(string_split(num, '.')) END AS level, CASE WHEN mark <> '' AND length(text) < 200 THEN trim(title) ELSE trim(num_title) END AS title, CASE WHEN NOT (mark <> '' AND length(text) < 200) AND num <> '' AND length(text) < 90 THEN num ELSE '' END AS clause_no FROM k_marks",
        "k_open": "SELECT *, " + ", ".join(f"max(CASE WHEN level = {n} THEN pos END) {at} AS p{n}, last_value(CASE WHEN level = {n} THEN substring(title, 1, 80) END IGNORE NULLS) {at} AS t{n}" for n in levels) + f", count(level) {at} AS sec FROM k_blocks",
        "k_paths": f"SELECT doc_id, pos, text, clause_no, sec, concat_ws(' > ', {', '.join(map(open_, levels))}) AS path, sum(length(text)) OVER (PARTITION BY doc_id, sec ORDER BY pos) AS upto FROM k_open",
        "k_secs": "SELECT doc_id, sec, path, list(upto ORDER BY pos) AS ends FROM k_paths GROUP BY 1, 2, 3",
        "k_groups": f"SELECT doc_id, sec, path, ends, 0 AS g, 0::hugeint AS before, list_filter(ends, lambda x: x >= {size})[1] AS stop FROM k_secs UNION ALL SELECT doc_id, sec, path, ends, g + 1, stop, list_filter(ends, lambda x: x - stop >= {size})[1] FROM k_groups WHERE stop IS NOT NULL AND stop < ends[-1]",
        "k_merged": f"SELECT g.doc_id, g.sec, g.path, g.g, {_CLEAN('string_agg(b.text, chr(10) ORDER BY b.pos)')} AS whole, coalesce(list_filter(list(CASE WHEN b.clause_no <> '' THEN b.clause_no ELSE {clause('b.text')} END ORDER BY b.pos), lambda x: x <> '')[1], '') AS clause FROM k_groups g JOIN k_paths b ON b.doc_id = g.doc_id AND b.sec = g.sec AND b.upto > g.before AND (g.stop IS NULL OR b.upto <= g.stop) GROUP BY ALL",
        "k_parts": f"SELECT *, CASE WHEN length(whole) <= {size} THEN [whole] ELSE list_filter(regexp_extract_all(whole, '[^{ends}]*[{ends}]|[^{ends}]+'), lambda x: trim(x) <> '') END AS parts FROM k_merged WHERE whole <> ''",
        "k_cuts": "SELECT *, array_to_string(parts, '') AS joined, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))) AS cuts FROM k_parts",
        "k_packs": f"""SELECT doc_id, sec, g, 0 AS k, cuts, 0::hugeint AS start, coalesce(list_filter(cuts, lambda x: x <= {size})[-1], cuts[1])::hugeint AS stop FROM k_cuts
          UNION ALL SELECT doc_id, sec, g, k + 1, cuts, greatest(stop - {overlap}, start), coalesce(list_filter(cuts, lambda x: x > stop AND x - greatest(stop - {overlap}, start) <= {size})[-1], list_filter(cuts, lambda x: x > stop)[1])::hugeint FROM k_packs WHERE stop < cuts[-1]""",
        "k_texts": f"SELECT doc_id, sec, g, k, path, whole, clause, {_TRIM('substring(joined, (start + 1)::bigint, (stop - start)::bigint)')} AS t FROM k_packs JOIN k_cuts USING (doc_id, sec, g)",
        "k_rows": f"SELECT doc_id, sec, g, k, path AS section_path, CASE WHEN length(whole) > {size} AND {clause('t')} <> '' THEN {clause('t')} ELSE clause END AS clause_no, regexp_matches(substring(t, 1, 150), '{'|'.join(T.MANDATORY)}') AS is_mandatory, CASE WHEN path = '' OR starts_with(t, string_split(path, ' > ')[-1]) THEN t ELSE '【' || path || '】' || chr(10) || t END AS content FROM k_texts",
        "chunks": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, g, k) - 1 AS seq, content, section_path, clause_no, NULL::int AS page_no, is_mandatory, length(content) AS char_count FROM k_rows WHERE length(content) > 0 AND (length(content) >= {least} OR clause_no <> '')",
    }


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


_SECTIONED = "SELECT doc_id, '# Part ' || doc_id % 3 || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '2.' || doc_id % 9 || ' Clause of the part' || chr(10) || chr(10) || substring(text, 1, 2000) || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || '3.1.2 must hold; ' || substring(text, 1, 900) AS text FROM documents"


@query(recursive(V.sql("SELECT * FROM chunks", **chunk_sql("SELECT doc_id, text FROM documents"))))
def document_chunks(spark, sf_dir):
    """Section-aware chunks; sentences of these texts end with a dot."""
    return ingest.chunks(V.table(spark, sf_dir, "documents"), ends=ingest.SENTENCE_ENDS + ".")


@query(recursive(V.sql("SELECT * FROM chunks", **chunk_sql(_SECTIONED))))
def sectioned_chunks(spark, sf_dir):
    """Chunks of texts with headings of three kinds, in which each line is a paragraph."""
    gap = F.lit("\n\n")
    text = F.concat(F.lit("# Part "), (F.col("doc_id") % 3).cast("string"), gap, F.replace("text", F.lit("\n"), gap), gap, F.lit("2."), (F.col("doc_id") % 9).cast("string"), F.lit(" Clause of the part"), gap, F.substring("text", 1, 2000), gap, F.lit("### Deep"), gap, F.lit("3.1.2 must hold; "), F.substring("text", 1, 900))
    return ingest.chunks(V.table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), ends=ingest.SENTENCE_ENDS + ".")


@query(recursive(V.sql("SELECT doc_id, seq, unnest(list_filter([CASE WHEN char_count > 1200 THEN 'oversized_chunk' END, CASE WHEN char_count < 40 THEN 'tiny_chunk' END, CASE WHEN trim(section_path) = '' AND trim(clause_no) = '' THEN 'missing_location' END], lambda x: x IS NOT NULL)) AS issue_type, CASE issue_type WHEN 'oversized_chunk' THEN 'medium' ELSE 'low' END AS severity FROM chunks", **chunk_sql("SELECT doc_id, text FROM documents"))))
def chunk_quality_issues(spark, sf_dir):
    return quality.static_issues(document_chunks(spark, sf_dir))
