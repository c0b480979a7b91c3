"""Lists and look-ups: filters, keyword, newest first with the id as the last key, and joins that lists show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.governance import granted


def listed(rows: DataFrame, key: str, keyword: str = "", over: tuple[str, ...] = (), newest: str | None = None, **equal) -> DataFrame:
    """Rows with these values (None: any) and the keyword, in any case, in one of the columns `over`, ordered
    by `newest`, latest first, then by key. Knowledge bases, documents, chunks, conversations, tasks, alerts, reports,
    runs and versions are listed so. A null column holds no keyword."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if keyword:
        hit = F.lit(False)
        for c in over:
            hit = hit | F.contains(F.lower(T.text_or_empty(F.col(c).cast("string"))), F.lit(keyword.lower()))
        rows = rows.where(hit)
    return rows if newest is None else rows.orderBy(F.desc(newest), key)


def at_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none takes the place of a not-found error."""
    return rows.where(F.col(key) == value)


def gaps_listed(gaps: DataFrame, k: int | None = None, status: str | None = None, intent: str | None = None) -> DataFrame:
    """Gaps (query_key, n, last_asked_at), the most asked and latest first; `k` gives the top of them."""
    g = listed(gaps, "query_key", status=status, intent=intent).orderBy(F.desc("n"), F.desc("last_asked_at"), "query_key")
    return g if k is None else g.limit(k)


def eval_rows(per_query: DataFrame) -> DataFrame:
    """Slim rows of a run: the query, what was expected, how much was found and the first hit's worth."""
    return per_query.select("query_id", "n_relevant", "mrr", "recall_5", (F.col("recall_5") > 0).alias("hit"))


def golden_summary(golden: DataFrame) -> DataFrame:
    """(query_id, n_relevant, negative) of golden items with `relevant` ids; no ids, or null, make a negative."""
    n = F.coalesce(F.size("relevant"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return golden.select("query_id", n.alias("n_relevant"), (n == 0).alias("negative"))


def with_titles(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Issues with the title of their document, empty where it is gone or none is named."""
    return issues.join(docs.select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left").withColumn("doc_title", T.text_or_empty(F.col("doc_title")))


def feedback_rows(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback with its message's conversation and user, and feedback on unknown messages or conversations."""
    known = messages.join(conversations.select("conv_id", "user_id"), "conv_id").select("message_id", "conv_id", "user_id")
    return feedback.join(known, "message_id"), feedback.join(known.select("message_id"), "message_id", "left_anti")


def writers(principals: DataFrame) -> DataFrame:
    """(user_id, keys) to write with: administrators write all, editors public ones and their tenant's, and a private one the roles it
    names. Nulls give no right."""
    role = F.concat(F.lit("role:"), "role")
    keys = F.when(F.col("role") == "admin", F.array(F.lit("*"))).when(F.col("role") == "editor", F.array(F.lit("public"), F.concat(F.lit("tenant:"), "tenant_id"), role)).otherwise(F.array(role))
    return principals.select("user_id", keys.alias("keys"))


def writable(principals: DataFrame, kbs: DataFrame) -> DataFrame:
    """(user_id, kb_id) pairs of what `writers` may write."""
    return granted(writers(principals), kbs)


def visible(kbs: DataFrame, tenant_id: str | None) -> DataFrame:
    """Knowledge bases that are public or of the tenant; versions and pages of one follow by a semi-join on kb_id."""
    return kbs.where(F.coalesce((F.col("visibility") == "public") | (F.col("tenant_id") == F.lit(tenant_id)), F.lit(False)))


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of the knowledge bases in the scope, before any retrieval; an empty scope leaves none."""
    return rows.join(scope.select("kb_id").distinct(), "kb_id", "left_semi")


def latest(reports: DataFrame, by: list[str], at: str = "created_at", tie: str = "report_id") -> DataFrame:
    """The latest report of each group."""
    w = W.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return reports.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def issue_share(reports: DataFrame) -> DataFrame:
    """(issue_type, n, share) over many reports with maps `issue_counts`."""
    n = reports.select(F.explode("issue_counts").alias("issue_type", "c")).groupBy("issue_type").agg(F.sum("c").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("issue_type", "n", F.round(F.try_divide(F.col("n"), F.col("total")), 4).alias("share"))  # one row


def kpis(reports: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: score and counts of the latest report, its band, and the alerts that are open."""
    r = reports.agg(*[F.max_by(c, F.struct("created_at", "report_id")).alias(c) for c in ("score", "issue_count", "high_count")])
    band = F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor")
    return r.crossJoin(F.broadcast(alerts.agg(F.count_if(~F.col("resolved")).alias("open_alerts")))).withColumn("band", band)  # one row each


def flat_metrics(runs: DataFrame, column: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """A column for each k of a map of metrics by k; what a map lacks is 0."""
    return runs.select("*", *[F.coalesce(F.col(column)[F.lit(str(k))], F.lit(0.0)).alias(f"{column}_{k}") for k in ks]).drop(column)


def due(as_of: Column, days: int = 14) -> Column:
    return as_of + F.make_dt_interval(F.lit(days))
