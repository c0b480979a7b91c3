"""Inspection from checks to one report: vector health, domain coverage, scores by scope, and what follows for gaps and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import norm
from corpuslens.operators.quality import HIGH_TYPES, penalty
from corpuslens.sources.sliced import small

#: What a report advises for issues of a kind, in this order; kinds that share an advice are told once.
ADVICE = (
    (("duplicate_chunk",), "merge near duplicates"), (("orphan_chunk",), "review chunks unlike all others"), (("missing_standard_code",), "add the standard codes"), (("missing_location",), "split by headings again"),
    (("oversized_chunk", "tiny_chunk"), "split by clauses"), (("missing_vector", "zero_vector"), "embed again"), (("domain_coverage_gap",), "add documents of the domain"), (("isolated_query",), "add documents that answer the queries"),
    (("low_recall_intent",), "add documents for the intents"),
)


def vector_health(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(kb_id, checked, missing, zero, completeness) of live chunks (key, kb_id): how many have no vector, or one of length 0. A null
    vector is none. A knowledge base without chunks has no row; keys are distinct."""
    v = vectors.where(F.col(vector).isNotNull()).select(key, (norm(F.col(vector)) == 0).alias("_zero"))
    c = chunks.select(key, "kb_id").join(v, key, "left").groupBy("kb_id").agg(F.count("*").alias("checked"), F.count_if(F.col("_zero").isNull()).alias("missing"), F.count_if("_zero").alias("zero"))
    return c.withColumn("completeness", F.round((F.col("checked") - F.col("missing")) / F.col("checked"), 4))


def coverage(chunks: DataFrame, intent_recall: DataFrame, routes: DataFrame, domains: tuple[str, ...] = ("standard", "case", "enterprise"), sparse: int = 3, low: float = 0.7) -> DataFrame:
    """(domain, n_chunks, low_intents, sparse, severity) of `domains` and of those that chunks or low intents name: how many chunks (domain)
    a domain has, and which intents of low mean recall (intent, recall) are routed (intent, domains) to it. A domain is sparse by
    few chunks or by such an intent; the severity is that of few chunks, null where there are enough."""
    spark = chunks.sparkSession
    n = chunks.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n"))
    weak = intent_recall.where(F.col("recall") < low).join(routes, "intent").select("intent", F.explode("domains").alias("domain")).groupBy("domain").agg(F.array_sort(F.collect_set("intent")).alias("low"))
    every = spark.createDataFrame([(d,) for d in domains], "domain string").unionByName(n.select("domain")).unionByName(weak.select("domain")).distinct()
    c = every.join(n, "domain", "left").join(weak, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("low", F.array().cast("array<string>")).alias("low_intents"))
    few = F.col("n_chunks") <= sparse
    return c.withColumn("sparse", few | (F.size("low_intents") > 0)).withColumn("severity", F.when(F.col("n_chunks") == 0, "high").when(few, "medium"))


def coverage_issues(covered: DataFrame) -> DataFrame:
    """Issues (domain, issue_type, severity) of domains with few chunks."""
    return covered.where("severity IS NOT NULL").select("domain", F.lit("domain_coverage_gap").alias("issue_type"), "severity")


def reports(issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, kb_id, n_chunks, issue_count, high_count, score, issue_counts, suggestions): a report of each knowledge base of `sizes` (kb_id,
    n_chunks) and one, scope `all`, of all issues (kb_id, issue_type, severity), those without knowledge base among them.
    `high_count` is of the types that alerts watch; counts are `type:n`, sorted."""
    i = issues.where("issue_type IS NOT NULL").groupBy("kb_id", "issue_type").agg(F.count("*").alias("n"), penalty().alias("p"))
    of = lambda rows, by: rows.groupBy(*by, "issue_type").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).groupBy(*by).agg(
        F.sum("n").alias("issue_count"), F.sum("p").alias("p"), F.sum(F.when(F.col("issue_type").isin(*HIGH_TYPES), F.col("n")).otherwise(0)).alias("high_count"),
        F.array_sort(F.collect_list(F.concat_ws(":", "issue_type", F.col("n").cast("string")))).alias("issue_counts"), F.collect_set("issue_type").alias("_kinds"),
    )
    each = sizes.select("kb_id", "n_chunks").join(of(i, ["kb_id"]), "kb_id", "left").withColumn("scope", F.lit("kb"))
    whole = sizes.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks")).withColumn("_one", F.lit(1)).join(of(i.withColumn("_one", F.lit(1)), ["_one"]), "_one", "left").drop("_one")
    r = each.unionByName(whole.withColumns({"scope": F.lit("all"), "kb_id": F.lit("")}))
    zero, none = F.lit(0), F.array().cast("array<string>")
    score = F.round(F.greatest(F.lit(0.0), 100.0 - F.coalesce("p", F.lit(0.0)) / F.greatest("n_chunks", F.lit(1)) * 20), 1)
    kinds = F.coalesce("_kinds", none)
    advice = F.filter(F.array(*[F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, names))), F.lit(words)) for names, words in ADVICE]), lambda x: x.isNotNull())
    return r.select(
        "scope", "kb_id", "n_chunks", F.coalesce("issue_count", zero).alias("issue_count"), F.coalesce("high_count", zero).alias("high_count"), score.alias("score"), F.coalesce("issue_counts", none).alias("issue_counts"),
        F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("keep inspecting"))).alias("suggestions"),
    )


def isolated_questions(issues: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """Isolated queries (query_id) as questions (query, created_at, intent, domains) that `governance.capture_gaps` takes; a column that
    the queries lack is null."""
    own = [F.col(c) if c in queries.columns else F.lit(None).cast("string" if c == "intent" else "array<string>").alias(c) for c in ("intent", "domains")]
    return issues.where("issue_type = 'isolated_query'").select("query_id").distinct().join(queries, "query_id").select("query", at.alias("created_at"), *own)


def kb_stats(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Knowledge bases (kb_id) with the number of their live documents and chunks, 0 where there are none."""
    live = lambda df, name: df.where(~F.coalesce("is_deleted", F.lit(False))).groupBy("kb_id").agg(F.count("*").alias(name))
    return kbs.select("kb_id").join(live(docs, "doc_count"), "kb_id", "left").join(live(chunks, "chunk_count"), "kb_id", "left").fillna(0, ["doc_count", "chunk_count"])


def overview(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: knowledge bases, live documents, those ready and failed, live chunks, mandatory ones, and `domain:documents`, sorted."""
    live = lambda df: df.where(~F.coalesce("is_deleted", F.lit(False)))
    d = live(docs).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"))
    d = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("doc_count"), F.coalesce(F.sum("ready"), F.lit(0)).alias("ready"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.array_sort(F.collect_list(F.concat_ws(":", "domain", F.col("n").cast("string")))).alias("docs_by_domain"))
    c = live(chunks).agg(F.count("*").alias("chunk_count"), F.count_if("is_mandatory").alias("mandatory_count"))
    return kbs.agg(F.count("*").alias("kb_count")).crossJoin(d).crossJoin(c)  # one row each


def kpis(reports: DataFrame, health: DataFrame, covered: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row for a dashboard: score, issues, watched issues and band of the latest report (report_id, created_at), chunks with a
    missing or zero vector, sparse domains and open alerts."""
    r = reports.agg(*[F.max_by(c, F.struct("created_at", "report_id")).alias(c) for c in ("score", "issue_count", "high_count")])
    band = F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor")
    out = r.withColumn("band", band).crossJoin(health.agg(F.coalesce(F.sum(F.col("missing") + F.col("zero")), F.lit(0)).alias("bad_vectors")))
    return out.crossJoin(covered.agg(F.count_if("sparse").alias("sparse_domains"))).crossJoin(alerts.agg(F.count_if(~F.col("resolved")).alias("open_alerts")))  # one row each


def request_rates(log: DataFrame, by: list[Column]) -> DataFrame:
    """(by, n, n_errors, error_rate, hits, lookups, hit_rate) of requests (status, cache: hit, miss or null). Rates of nothing are 0."""
    hit, looked = F.count_if(F.col("cache") == "hit"), F.count_if(F.col("cache").isin("hit", "miss"))
    errors = F.count_if(F.col("status") >= 500)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return log.groupBy(*by).agg(F.count("*").alias("n"), errors.alias("n_errors"), rate(errors, F.count("*")).alias("error_rate"), hit.alias("hits"), looked.alias("lookups"), rate(hit, looked).alias("hit_rate"))


def gates(kbs: DataFrame, docs_chunks: DataFrame, health: DataFrame, latest: DataFrame, required: tuple[str, ...] = ("standard", "case", "enterprise"), complete: float = 0.99, least: float = 80.0) -> DataFrame:
    """The release gate of each knowledge base (kb_id), from its live chunks (kb_id, domain), `vector_health` and latest report (kb_id, score):
    what fails it, in order, as `reasons`; a note where no report says its score, which passes; and whether all passed."""
    doms = docs_chunks.groupBy("kb_id").agg(F.count("*").alias("total_chunks"), F.collect_set("domain").alias("_domains"))
    g = kbs.select("kb_id").join(doms, "kb_id", "left").join(health.select("kb_id", "missing", "zero"), "kb_id", "left").join(latest.select("kb_id", "score"), "kb_id", "left").fillna(0, ["total_chunks", "missing", "zero"])
    share = F.coalesce(F.round(F.try_divide(F.col("total_chunks") - F.col("missing"), F.col("total_chunks")), 4), F.lit(1.0))
    empty = F.array_except(F.array(*[F.lit(d) for d in required]), F.coalesce("_domains", F.array().cast("array<string>")))
    g = g.withColumns({"completeness": share, "empty_domains": empty})
    failed = F.filter(F.array(
        F.when(F.col("completeness") < complete, "vectors_incomplete"), F.when(F.col("score") < least, "score_low"), F.when(F.col("missing") > 0, "vectors_missing"), F.when(F.col("zero") > 0, "vectors_zero"), F.when(F.size("empty_domains") > 0, "domain_empty"),
    ), lambda x: x.isNotNull())
    g = g.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0).withColumn("note", F.when(F.col("score").isNull(), "not inspected yet, score unknown"))
    g = g.select("kb_id", "total_chunks", "completeness", "score", F.col("missing").alias("missing_vectors"), F.col("zero").alias("zero_vectors"), "empty_domains", "reasons", "passed", "note")
    return g.crossJoin(small(g.agg(F.bool_and("passed").alias("overall"))))  # one row


def accepted_gaps(gaps: DataFrame, as_of: Column, tasks: DataFrame | None = None, often: int = 3, days: int = 14) -> DataFrame:
    """Tasks of gaps (query_key, query, intent, domains, n) that have none in `tasks` (query_key): type, title, text, priority by how often
    they were asked, and due date."""
    new = gaps if tasks is None else gaps.join(tasks.select("query_key").distinct(), "query_key", "left_anti")
    named = F.array_join(F.coalesce("domains", F.array().cast("array<string>")), ", ")
    text = F.concat(F.lit("asked "), F.col("n").cast("string"), F.lit(" times (intent "), T.text_or_empty(F.col("intent")), F.lit("): "), T.text_or_empty(F.col("query")), F.lit("; add to: "), F.when(named == "", "any domain").otherwise(named))
    return new.select(
        "query_key", F.lit("gap_fill").alias("task_type"), F.concat(F.lit("fill: "), F.substring(T.text_or_empty(F.col("query")), 1, 30)).alias("title"), text.alias("description"),
        F.when(F.col("n") >= often, "high").otherwise("medium").alias("priority"), (as_of + F.make_dt_interval(F.lit(days))).alias("due_date"),
    )
