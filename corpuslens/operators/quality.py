"""Chunk and corpus checks, their score, alerts between snapshots, and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import norm

SEVERITY = {"high": 6.0, "medium": 3.0, "low": 1.0}
# The types of issues whose rise is alerted.
HIGH_TYPES = ("low_recall_intent", "zero_vector", "isolated_query")


def penalty(severity: str = "severity"):
    return F.sum(F.when(F.col(severity) == "high", 6.0).when(F.col(severity) == "medium", 3.0).otherwise(1.0))


def static_issues(chunks: DataFrame, largest: int = 1200, least: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, seq, columns to keep, issue_type, severity) for oversized and tiny chunks and chunks without any location."""
    kinds = F.filter(F.array(
        F.when(F.col("char_count") > largest, F.struct(F.lit("oversized_chunk").alias("issue_type"), F.lit("medium").alias("severity"))),
        F.when(F.col("char_count") < least, F.struct(F.lit("tiny_chunk").alias("issue_type"), F.lit("low").alias("severity"))),
        F.when(T.blank(F.col("section_path")) & T.blank(F.col("clause_no")), F.struct(F.lit("missing_location").alias("issue_type"), F.lit("low").alias("severity"))),
    ), lambda x: x.isNotNull())
    return chunks.select("doc_id", "seq", *keep, F.explode(kinds).alias("i")).select("doc_id", "seq", *keep, "i.*")


def vector_issues(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, issue_type, severity) of chunks whose vector is missing or has length 0. What is wanted of a chunk beside its
    key is kept, not joined to the issues: a join with a union of joins on the same key can fail once Spark has coalesced its parts."""
    zero = F.bool_or(F.coalesce(norm(F.col("vector")) == 0, F.lit(False)))
    held = vectors.where(F.col("vector").isNotNull()).groupBy(key).agg(zero.alias("_zero"))
    issue = lambda kind, severity: F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"))
    found = F.when(F.col("_zero").isNull(), issue("missing_vector", "medium")).when(F.col("_zero"), issue("zero_vector", "high"))
    return chunks.select(key, *keep).join(held, key, "left").select(key, *keep, found.alias("i")).where("i IS NOT NULL").select(key, *keep, "i.*")


def score(issues: DataFrame, n_chunks: int) -> DataFrame:
    """max(0, 100 - penalty / chunks * 20), with counts."""
    per = F.coalesce(penalty(), F.lit(0.0)) / max(n_chunks, 1) * 20
    return issues.agg(F.round(F.greatest(F.lit(0.0), 100.0 - per), 1).alias("score"), F.count("*").alias("issue_count"))


def kb_scores(issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """(kb_id, score, issue_count, high_count) of each knowledge base of `sizes` (kb_id, n_chunks), by its issues; `high_count` is of
    HIGH_TYPES."""
    i = issues.groupBy("kb_id").agg(penalty().alias("p"), F.count("*").alias("n"), F.count_if(F.col("issue_type").isin(*HIGH_TYPES)).alias("high"))
    per = F.coalesce("p", F.lit(0.0)) / F.greatest("n_chunks", F.lit(1)) * 20
    return sizes.join(i, "kb_id", "left").select("kb_id", F.round(F.greatest(F.lit(0.0), 100.0 - per), 1).alias("score"), F.coalesce("n", F.lit(0)).alias("issue_count"), F.coalesce("high", F.lit(0)).alias("high_count"))


def alerts(reports: DataFrame, threshold: float = 80.0, rise: int = 1) -> DataFrame:
    """Alerts of reports (report_id, tenant_id, kb_id, created_at, score, high_count: issues of HIGH_TYPES): a score under the threshold,
    or `rise` more such issues than in the report before."""
    at = W.partitionBy("tenant_id", "kb_id").orderBy("created_at", "report_id")
    r = reports.withColumn("prev_high", F.coalesce(F.lag("high_count").over(at), F.lit(0)))
    kinds = F.filter(F.array(F.when(F.col("score") < threshold, F.lit("low_score")), F.when(F.col("high_count") - F.col("prev_high") >= rise, F.lit("new_high_severity"))), lambda x: x.isNotNull())
    return r.select("report_id", "tenant_id", "kb_id", F.explode(kinds).alias("alert_type"), "score", "high_count", "prev_high")


def tasks_from_issues(issues: DataFrame, open_tasks: DataFrame, types: dict[str, str], as_of: Column | None = None, days: int = 14) -> DataFrame:
    """One task for each (task_type, doc_id) of high issues that name a document, without those open already; due `days` after `as_of`,
    where that is given."""
    kind = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    t = issues.where((F.col("severity") == "high") & ~T.blank(F.col("doc_id").cast("string"))).select(F.coalesce(kind[F.col("issue_type")], F.lit("review")).alias("task_type"), "doc_id").distinct()
    return t.join(open_tasks.select("task_type", "doc_id"), ["task_type", "doc_id"], "left_anti").withColumn("due_days", F.lit(days)).withColumn("due_date", F.lit(None).cast("timestamp") if as_of is None else as_of + F.make_dt_interval(F.lit(days)))


def missing_codes(docs: DataFrame, domain: str = "standard") -> DataFrame:
    """Documents of the standard domain without standard code, each once."""
    return docs.where((F.col("domain") == domain) & T.blank(F.col("standard_code"))).select("doc_id", F.lit("missing_standard_code").alias("issue_type"), F.lit("medium").alias("severity")).distinct()


def sparse_domains(chunks: DataFrame, domains: tuple[str, ...] = ("standard", "case", "enterprise"), least: int = 3) -> DataFrame:
    """(domain, n_chunks, severity) of all `domains` with no more than `least` chunks, those without any as well."""
    every = chunks.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    n = every.join(chunks.groupBy("domain").agg(F.count("*").alias("n")), "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n_chunks"))
    return n.where(F.col("n_chunks") <= least).withColumn("severity", F.when(F.col("n_chunks") == 0, "high").otherwise("medium"))


def intent_recall(per_query: DataFrame, intents: DataFrame, least: float = 0.7) -> DataFrame:
    """(intent, n, recall, low): mean recall of each expected intent's queries (query_id, recall_5)."""
    g = per_query.join(intents.select("query_id", "intent"), "query_id").groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg("recall_5"), 4).alias("recall"))
    return g.withColumn("low", F.col("recall") < least)


def isolated_queries(golden: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, issue_type, severity) of queries with relevant documents that found no candidate at all; they also feed the knowledge gaps."""
    lost = golden.select("query_id").distinct().join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    return lost.select("query_id", F.lit("isolated_query").alias("issue_type"), F.lit("high").alias("severity"))


def inspection(issues: DataFrame, n_chunks: int, keep: int = 200) -> tuple[DataFrame, DataFrame]:
    """(issue_type, severity, n) counts, and the issues a report keeps: the gravest first, then by type and place. The score is that of `score`."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("n")), issues.orderBy(rank, "issue_type", *[c for c in ("doc_id", "seq") if c in issues.columns]).limit(keep)


def suggestions(counts: DataFrame) -> DataFrame:
    """(issue_type, n, suggestion) rows of counted issues (issue_type, n)."""
    words = {
        "duplicate_chunk": "merge or remove near duplicates", "orphan_chunk": "review chunks unlike all others", "missing_standard_code": "add the standard codes", "missing_location": "split by headings again",
        "oversized_chunk": "split by clauses", "tiny_chunk": "join with neighbours", "missing_vector": "embed again", "zero_vector": "embed again", "domain_coverage_gap": "add documents of the domain", "isolated_query": "add documents that answer it",
    }
    kind = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return counts.groupBy("issue_type").agg(F.sum("n").alias("n")).withColumn("suggestion", F.coalesce(kind[F.col("issue_type")], F.lit("review")))
