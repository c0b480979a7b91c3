"""Document health, knowledge gaps, operation reports, release gates, latency, versions and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.quality import penalty
from corpuslens.sources.sliced import small

BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def days_between(a: Column, b: Column) -> Column:
    """Whole days of a - b, rounded down."""
    return F.floor((F.unix_micros(a) - F.unix_micros(b)) / F.lit(86400e6))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(reason, doc_id, n): documents that share a hash anywhere, or a title within a kb; the smallest id stands for each group."""
    by_hash = docs.where(~T.blank(F.col("file_hash"))).groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    by_title = docs.groupBy("kb_id", F.lower(F.trim("title")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return by_hash.select(F.lit("hash").alias("reason"), "doc_id", "n").unionByName(by_title.select(F.lit("title").alias("reason"), "doc_id", "n")).where("n > 1")


def health_issues(docs: DataFrame, as_of: Column, soon: int = 90, stale: int = 365) -> DataFrame:
    """(issue_type, severity, doc_id) of documents without the deleted ones."""
    live = docs.where(~F.col("is_deleted"))
    left = days_between(F.col("expire_date"), as_of)
    issue = lambda kind, sev, when: F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(sev).alias("severity")))
    expired = F.coalesce((F.col("expire_date") <= as_of) & (F.col("governance_status") != "deprecated"), F.lit(False))
    kinds = F.filter(F.array(
        issue("expired", "high", expired), issue("expiring_soon", "medium", ~expired & (left > 0) & (left <= soon)), issue("no_owner", "medium", T.blank(F.col("owner"))),
        issue("stale", "low", (days_between(as_of, F.col("updated_at")) > stale) & (F.col("governance_status") == "valid")),
        issue("parse_failed", "high", F.col("status") == "failed"), issue("empty_summary", "low", T.blank(F.col("summary"))),
    ), lambda x: x.isNotNull())
    own = live.select(F.explode(kinds).alias("i"), "doc_id").select("i.issue_type", "i.severity", "doc_id")
    return own.unionByName(duplicate_groups(live).select(F.lit("duplicate").alias("issue_type"), F.lit("medium").alias("severity"), "doc_id"))


def health_score(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: max(0, 100 - penalty / documents * 12)."""
    n = docs.where(~F.col("is_deleted")).agg(F.count("*").alias("total_docs"))
    p = issues.agg(F.coalesce(penalty(), F.lit(0.0)).alias("penalty"), F.count("*").alias("n_issues"))
    return n.crossJoin(F.broadcast(p)).select("total_docs", "n_issues", F.round(F.greatest(F.lit(0.0), 100.0 - F.col("penalty") / F.greatest("total_docs", F.lit(1)) * 12.0), 1).alias("score"))  # one row each


def gap_report(log: DataFrame, as_of: Column, days: int = 30, floor: float = 0.45, limit: int = 20) -> DataFrame:
    """The most frequent questions that found nothing or little, by token key."""
    recent = log.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("intent") != "chitchat") & ((F.col("hit_count") == 0) | (F.col("confidence") < floor)))
    key = T.report_key(F.col("query"))
    g = recent.groupBy(key.alias("query_key")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.bool_and(F.col("hit_count") == 0).alias("no_hits"))
    return g.orderBy(F.desc("n"), "avg_confidence", "query_key").limit(limit)


def capture_gaps(gaps: DataFrame, asked: DataFrame, latest: tuple[str, ...] = ()) -> DataFrame:
    """Gaps (query_key, n, last_asked_at, status) after more questions (query, created_at); decided ones stay as they are. Of the
    columns `latest`, such as query, intent and domains, an open gap takes those of its latest question, which both tables have."""
    last = F.max(F.struct("created_at", *latest)).alias("last")
    new = asked.groupBy(T.token_key(F.col("query")).alias("query_key")).agg(F.count("*").alias("more"), F.max("created_at").alias("at"), last)
    g = gaps.join(new, "query_key", "full_outer")
    is_open = F.coalesce(F.col("status"), F.lit("open")) == "open"
    newer = is_open & F.col("at").isNotNull() & (F.col("last_asked_at").isNull() | (F.col("at") >= F.col("last_asked_at")))
    return g.select(
        "query_key", F.when(is_open, F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).otherwise(F.col("n")).alias("n"),
        F.when(is_open, F.greatest("last_asked_at", "at")).otherwise(F.col("last_asked_at")).alias("last_asked_at"), F.coalesce("status", F.lit("open")).alias("status"),
        *[F.when(newer, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in latest],
    )


def operation_metrics(log: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Queries, unanswered, answer rate, mean confidence and latency; `by` groups, a time window for instance."""
    return log.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), F.count_if(~F.col("answered")).alias("n_unanswered"),
        F.round(F.coalesce(F.try_divide(F.count_if("answered"), F.count("*")), F.lit(0.0)), 4).alias("answer_rate"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"), F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).alias("avg_latency_ms"),
    )


def dashboard(gaps: DataFrame, tasks: DataFrame, log: DataFrame, since: Column, docs: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(measure, name, value) rows: gaps by status and intent, tasks by status and those pending, questions and the answer
    rate since then. With `docs` also live documents by domain, and the `top` open gaps (query_key, n, last_asked_at) by how often
    and how lately they were asked."""
    rows = [gaps.groupBy(F.col(c).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(f"gaps_by_{c}").alias("measure"), "name", "value") for c in ("status", "intent")]
    rows.append(tasks.groupBy(F.col("status").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("tasks_by_status").alias("measure"), "name", "value"))
    one = lambda df, *kv: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.lit("").alias("name"), v.cast("double").alias("value")) for k, v in kv])).alias("r")).select("r.*")
    rows.append(one(gaps.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open")), ("gap_total", F.col("n")), ("open_gaps", F.col("open"))))
    rows.append(one(tasks.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("open", "processing")).alias("p")), ("task_total", F.col("n")), ("pending_tasks", F.col("p"))))
    weak = ~F.coalesce("answered", F.lit(False)) | (F.coalesce("hit_count", F.lit(0)) == 0)
    asked = log.where(F.col("created_at") >= since).agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"))
    rows.append(one(asked, ("total_queries", F.col("n")), ("answer_rate", F.round(F.coalesce(F.try_divide(F.col("n") - F.col("weak"), F.col("n")), F.lit(0.0)), 3))))
    if docs is not None:
        live = docs.where(~F.coalesce("is_deleted", F.lit(False))).groupBy(F.col("domain").alias("name")).agg(F.count("*").cast("double").alias("value"))
        most = gaps.where("status = 'open'").orderBy(F.desc("n"), F.desc("last_asked_at"), "query_key").limit(top)
        rows += [live.select(F.lit("docs_by_domain").alias("measure"), "name", "value"), most.select(F.lit("top_gaps").alias("measure"), F.col("query_key").alias("name"), F.col("n").cast("double").alias("value"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def operation_topics(log: DataFrame, start: Column, as_of: Column, topics: int = 10, gaps: int = 10) -> DataFrame:
    """One row beside `operation_report`: `hot_topics` of the questions since `start` and the `gaps` of `gap_report`, each as
    `text:count`, the most frequent first."""
    told = lambda df, name, key: df.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("t")))), lambda x: F.concat(x["t"], F.lit(":"), (-x["m"]).cast("string"))).alias(name))  # noqa: E731  a few rows
    hot = hot_topics(log.where(F.col("created_at") >= start), topics)
    return told(hot, "hot_topics", "token").crossJoin(told(gap_report(log, as_of, limit=gaps), "gaps", "query_key"))  # one row each


def operation_report(docs: DataFrame, chunks: DataFrame, log: DataFrame, tasks: DataFrame, feedback: DataFrame, start: Column) -> DataFrame:
    """One row since `start`: new documents and chunks, questions, answer rate, confidence, latency, pending tasks, negative
    feedback and the suggestions that follow. Hot topics and gaps are those of `hot_topics` and `gap_report`."""
    new = lambda df: df.where(F.col("created_at") >= start)
    weak = ~F.coalesce("answered", F.lit(False)) | (F.coalesce("hit_count", F.lit(0)) == 0)
    asked = new(log).agg(F.count("*").alias("total_queries"), F.count_if(weak).alias("unanswered"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"), F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).alias("avg_latency_ms"))
    asked = asked.withColumn("answer_rate", F.round(F.coalesce(F.try_divide(F.col("total_queries") - F.col("unanswered"), F.col("total_queries")), F.lit(0.0)), 3))
    out = asked.crossJoin(new(docs).agg(F.count("*").alias("new_docs"))).crossJoin(new(chunks).agg(F.count("*").alias("new_chunks")))  # one row each
    out = out.crossJoin(tasks.agg(F.count_if(F.col("status").isin("open", "processing")).alias("pending_tasks"))).crossJoin(new(feedback).agg(F.count_if(F.col("rating") < 0).alias("negative_feedback")))
    some = F.col("total_queries") > 0
    advice = F.filter(F.array(
        F.when(some & (F.col("answer_rate") < 0.8), "fill the knowledge gaps"), F.when(some & (F.col("avg_confidence") < 0.5), "check chunks, summaries and vectors"),
        F.when(F.col("pending_tasks") > 10, "assign the pending tasks"), F.when(F.col("negative_feedback") > 0, "review the negative feedback"), F.when(F.col("new_docs") == 0, "add documents"),
    ), lambda x: x.isNotNull())
    return out.withColumn("suggestions", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("keep going"))))


def hot_topics(log: DataFrame, k: int = 10) -> DataFrame:
    t = log.select(F.explode(T.tokenize(F.col("query"))).alias("token")).where(F.length("token") >= 2)
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def latency_histogram(log: DataFrame, col: str = "latency_ms", bounds: tuple[int, ...] = BUCKETS_MS) -> DataFrame:
    """(bucket, le, n, cumulative) over the fixed buckets; the last has no upper bound."""
    at = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(F.col(col) <= bounds[i], i).otherwise(at)
    every = log.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(bounds)] + [(len(bounds), None)], "bucket int, le double")
    n = log.where(F.col(col).isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    h = every.join(n, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return h.withColumn("cumulative", F.sum("n").over(W.orderBy("bucket")))  # a row for each bucket


def quantiles(histogram: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Linear interpolation within the bucket that holds the quantile; the open bucket gives its lower bound."""
    w = W.orderBy("bucket")
    h = histogram.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.col("cumulative") - F.col("n"))
    total = h.agg(F.sum("n").alias("total"))
    h = h.crossJoin(F.broadcast(total)).select("*", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))  # one row
    h = h.where((F.col("cumulative") >= F.col("q") * F.col("total")) & (F.col("n") > 0))
    h = h.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("bucket"))).where("r = 1")
    at = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("q") * F.col("total") - F.col("before")) / F.col("n")
    return h.select("q", F.round(F.coalesce(at, F.col("lo")), 4).alias("value"))


def release_gate(kbs: DataFrame, required: tuple[str, ...] = ("standard", "case", "enterprise"), complete: float = 0.99, least: float = 80.0) -> DataFrame:
    """Adds reasons and passed to rows (kb_id, n_chunks, n_vectors, zero_vectors, score, domains); an unknown score passes."""
    no_domain = F.array_except(F.array(*[F.lit(d) for d in required]), F.coalesce("domains", F.array().cast("array<string>")))
    reasons = F.filter(F.array(
        F.when(F.coalesce(F.try_divide(F.col("n_vectors"), F.col("n_chunks")), F.lit(1.0)) < complete, F.lit("vectors_incomplete")),
        F.when(F.col("score") < least, F.lit("score_low")),
        F.when((F.col("n_vectors") < F.col("n_chunks")) | (F.col("zero_vectors") > 0), F.lit("vectors_missing_or_zero")),
        F.when(F.size(no_domain) > 0, F.lit("domain_empty")),
    ), lambda x: x.isNotNull())
    return kbs.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def version_diff(version: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change): removed ones are of the version only, added ones of the present only."""
    return version.join(current, key, "left_anti").select(key, F.lit("removed").alias("change")).unionByName(current.join(version, key, "left_anti").select(key, F.lit("added").alias("change")))


def grants(kbs: DataFrame) -> DataFrame:
    """(kb_id, key): all knowledge bases grant `*`, public ones `public`, those of a tenant `tenant:` and its name, private ones `role:`
    and each role they name."""
    roles = F.transform(F.array_distinct(F.coalesce("allowed_roles", F.array().cast("array<string>"))), lambda r: F.concat(F.lit("role:"), r))
    own = F.when(F.col("visibility") == "public", F.array(F.lit("public"))).when(F.col("visibility") == "tenant", F.array(F.concat(F.lit("tenant:"), "tenant_id"))).when(F.col("visibility") == "private", roles)
    return kbs.select("kb_id", F.explode(F.concat(F.array(F.lit("*")), F.coalesce(own, F.array().cast("array<string>")))).alias("key"))


def granted(users: DataFrame, kbs: DataFrame) -> DataFrame:
    """(user_id, kb_id) of users with `keys` and knowledge bases that grant one of them; a join on the key."""
    return users.select("user_id", F.explode("keys").alias("key")).join(small(grants(kbs)), "key").select("user_id", "kb_id")


def granted_totals(users: DataFrame, kbs: DataFrame) -> DataFrame:
    """(user_id, n, first, last): how many rows `granted` has for a user, and the smallest and largest knowledge base, from the totals of
    each key, without the pairs."""
    per = grants(kbs).groupBy("key").agg(F.count("*").alias("n"), F.min("kb_id").alias("first"), F.max("kb_id").alias("last"))
    return users.select("user_id", F.explode("keys").alias("key")).join(small(per), "key").groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def readers(principals: DataFrame) -> DataFrame:
    """(user_id, keys) to read with: administrators see all, others public ones, their tenant's, and private ones that name their role. No
    two keys of a user are granted by the same knowledge base. Nulls give no right, but for public ones."""
    keys = F.array(F.lit("public"), F.concat(F.lit("tenant:"), "tenant_id"), F.concat(F.lit("role:"), "role"))
    return principals.select("user_id", F.when(F.col("role") == "admin", F.array(F.lit("*"))).otherwise(keys).alias("keys"))


def accessible(principals: DataFrame, kbs: DataFrame) -> DataFrame:
    """(user_id, kb_id) pairs of what `readers` may read."""
    return granted(readers(principals), kbs)
