"""Queries of access, lists, alerts, tasks and deletion, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import evaluate, governance, lists, quality, versions
from corpuslens.plans import views as V
from corpuslens.plans.registry import _CLEAN, _TRIM, query

#: Customers play users and suppliers knowledge bases.
_ACCESS = {
    "users": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 97 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'editor' WHEN c_custkey % 11 <> 1 THEN 'viewer' END AS role, concat('t', c_nationkey % 5) AS tenant_id FROM customer",
    "kbs": """SELECT s_suppkey AS kb_id, ['public', 'tenant', 'private', NULL][s_suppkey % 4 + 1] AS visibility, CASE WHEN s_suppkey % 13 <> 1 THEN concat('t', s_nationkey % 5) END AS tenant_id,
        CASE s_suppkey % 3 WHEN 0 THEN ['viewer', 'viewer'] WHEN 1 THEN ['editor', 'viewer'] END AS allowed_roles FROM supplier""",
}


def _users(spark, sf_dir) -> DataFrame:
    i = F.col("c_custkey")
    role = F.when(i % 97 == 0, "admin").when(i % 3 == 0, "editor").when(i % 11 != 1, "viewer")
    return V.table(spark, sf_dir, "customer").select(i.alias("user_id"), role.alias("role"), F.concat(F.lit("t"), F.col("c_nationkey") % 5).alias("tenant_id"))


def _kbs(spark, sf_dir) -> DataFrame:
    i, names = F.col("s_suppkey"), lambda *x: F.array(*map(F.lit, x))
    return V.table(spark, sf_dir, "supplier").select(
        i.alias("kb_id"), F.element_at(names("public", "tenant", "private", None), (i % 4 + 1).cast("int")).alias("visibility"), F.when(i % 13 != 1, F.concat(F.lit("t"), F.col("s_nationkey") % 5)).alias("tenant_id"),
        F.when(i % 3 == 0, names("viewer", "viewer")).when(i % 3 == 1, names("editor", "viewer")).alias("allowed_roles"),
    )


_ROLE = "(k.visibility = 'private' AND list_contains(k.allowed_roles, u.role))"
_TENANT = "(k.visibility = 'tenant' AND u.tenant_id = k.tenant_id)"


@query(V.sql(f"""SELECT user_id, count(*) AS n, min(kb_id) AS first, max(kb_id) AS last FROM users u JOIN kbs k
    ON coalesce(u.role = 'admin', false) OR coalesce(k.visibility = 'public' OR {_TENANT} OR {_ROLE}, false) GROUP BY user_id""", **_ACCESS))  # fmt: skip
def readable_kbs(spark, sf_dir):
    """How many knowledge bases each user may read."""
    return governance.granted_totals(governance.readers(_users(spark, sf_dir)), _kbs(spark, sf_dir))


@query(V.sql(f"""SELECT user_id, count(*) AS n, min(kb_id) AS first, max(kb_id) AS last FROM users u JOIN kbs k
    ON coalesce(u.role = 'admin', false) OR coalesce(u.role = 'editor' AND (k.visibility = 'public' OR {_TENANT}), false) OR coalesce({_ROLE}, false) GROUP BY user_id""", **_ACCESS))  # fmt: skip
def writable_kbs(spark, sf_dir):
    """How many knowledge bases each user may write."""
    return governance.granted_totals(lists.writers(_users(spark, sf_dir)), _kbs(spark, sf_dir))


@query(V.sql("SELECT * FROM kbs WHERE visibility = 'public' OR tenant_id = 't1'", **_ACCESS))
def visible_kbs(spark, sf_dir):
    """Knowledge bases whose versions a tenant sees."""
    return lists.visible(_kbs(spark, sf_dir), "t1")


@query(V.sql("SELECT doc_id, kb_id, title, updated_at FROM document_v WHERE status = 'ready' AND domain = 'standard' AND (contains(lower(title), 'the') OR contains(lower(coalesce(summary, '')), 'the'))", "document_v"))
def listed_documents(spark, sf_dir):
    """Documents with two filters and a keyword, newest first."""
    return lists.listed(V.document_v(spark, sf_dir), "doc_id", "The", ("title", "summary"), "updated_at", status="ready", domain="standard").select("doc_id", "kb_id", "title", "updated_at")


#: A day of a user group's events plays an inspection report.
_REPORTS = {
    "reports": """SELECT concat(user_id % 7, '-', ts::date) AS report_id, concat('t', user_id % 7 % 3) AS tenant_id, user_id % 7 AS kb_id, ts::date::timestamp AS created_at,
        greatest(0, 100 - 4 * count(*) FILTER (event_type = 'error'))::double AS score, count(*) FILTER (event_type = 'error' AND value > 20) AS high_count FROM events GROUP BY user_id % 7, ts::date""",
}


def _reports(spark, sf_dir) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumns({"kb_id": F.col("user_id") % 7, "day": F.to_date("ts")})
    bad = F.col("event_type") == "error"
    r = e.groupBy("kb_id", "day").agg(F.greatest(F.lit(0), 100 - 4 * F.count_if(bad)).cast("double").alias("score"), F.count_if(bad & (F.col("value") > 20)).alias("high_count"))
    return r.select(F.concat_ws("-", "kb_id", "day").alias("report_id"), F.concat(F.lit("t"), F.col("kb_id") % 3).alias("tenant_id"), "kb_id", F.col("day").cast("timestamp").alias("created_at"), "score", "high_count")


@query(V.sql("""SELECT report_id, tenant_id, kb_id, unnest(list_filter([CASE WHEN score < 80 THEN 'low_score' END, CASE WHEN high_count - prev_high >= 1 THEN 'new_high_severity' END], lambda x: x IS NOT NULL)) AS alert_type, score, high_count, prev_high
    FROM (SELECT *, coalesce(lag(high_count) OVER (PARTITION BY tenant_id, kb_id ORDER BY created_at, report_id), 0) AS prev_high FROM reports)""", **_REPORTS))  # fmt: skip
def report_alerts(spark, sf_dir):
    """Alerts of each report beside the one before."""
    return quality.alerts(_reports(spark, sf_dir))


@query(V.sql("SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY created_at DESC, report_id DESC) = 1", **_REPORTS))
def latest_reports(spark, sf_dir):
    """The latest report of each knowledge base."""
    return lists.latest(_reports(spark, sf_dir), ["kb_id"])


_TASKS = {
    "issues": "SELECT doc_id, CASE WHEN governance_status = 'deprecated' THEN 'expired' ELSE 'no_summary' END AS issue_type, CASE WHEN governance_status = 'deprecated' OR doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM document_v WHERE governance_status = 'deprecated' OR summary = ''",
    "open_tasks": "SELECT 'renew' AS task_type, doc_id FROM documents WHERE doc_id % 30 = 0",
    "tasks": "SELECT DISTINCT CASE issue_type WHEN 'expired' THEN 'renew' ELSE 'review' END AS task_type, doc_id FROM issues WHERE severity = 'high'",
}


def _tasks(spark, sf_dir) -> DataFrame:
    d = V.document_v(spark, sf_dir)
    old = F.col("governance_status") == "deprecated"
    issues = d.where(old | (F.col("summary") == "")).select("doc_id", F.when(old, "expired").otherwise("no_summary").alias("issue_type"), F.when(old | (F.col("doc_id") % 2 == 0), "high").otherwise("low").alias("severity"))
    given = V.table(spark, sf_dir, "documents").where("doc_id % 30 = 0").select(F.lit("renew").alias("task_type"), "doc_id")
    return quality.tasks_from_issues(issues, given, {"expired": "renew"}, V.as_of())


@query(V.sql("""SELECT task_type, doc_id, 14 AS due_days, timestamp '2024-07-15' AS due_date, CASE WHEN doc_id % 4 = 0 THEN 'lead' ELSE owner END AS assignee
    FROM tasks ANTI JOIN open_tasks USING (task_type, doc_id) LEFT JOIN document_v USING (doc_id)""", "document_v", **_TASKS))  # fmt: skip
def assigned_tasks(spark, sf_dir):
    """Tasks of grave issues without those open already, given to the owner of the document where nobody has them."""
    t = _tasks(spark, sf_dir).withColumn("assignee", F.when(F.col("doc_id") % 4 == 0, "lead").otherwise(" "))
    return versions.with_assignee(t, V.document_v(spark, sf_dir))


@query(V.sql("""SELECT kind, kb_id, count(*) AS n, count(*) FILTER (del) AS n_deleted FROM (SELECT unnest(['document', 'chunk']) AS kind, kb_id, doc_id,
    CASE WHEN doc_id % 9 = 0 THEN true WHEN doc_id % 100 = 0 THEN false ELSE is_deleted END AS del, d.n_chunks FROM (SELECT *, doc_id % 4 + 1 AS n_chunks FROM document_v) d), range(0, 5) r(i)
    WHERE i < CASE kind WHEN 'document' THEN 1 ELSE n_chunks END GROUP BY kind, kb_id""", "document_v"))  # fmt: skip
def deleted_rows(spark, sf_dir):
    """Documents and chunks of each knowledge base after some are deleted and others restored."""
    docs = V.document_v(spark, sf_dir).select("kb_id", "doc_id", "is_deleted")
    chunks = docs.select("*", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4)).alias("seq"))
    gone, back = (docs.where(F.col("doc_id") % k == 0) for k in (9, 100))
    docs, chunks = versions.cascade(*versions.cascade(docs, chunks, back, deleted=False), gone)
    rows = docs.select(F.lit("document").alias("kind"), "kb_id", "is_deleted").unionAll(chunks.select(F.lit("chunk"), "kb_id", "is_deleted"))
    return rows.groupBy("kind", "kb_id").agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("n_deleted"))


_FEEDBACK = {
    "feedback": "SELECT event_id, event_id % 997 * 3 AS message_id, value FROM events WHERE event_type = 'click'",
    "messages": "SELECT conv_id * 4 + turn AS message_id, conv_id FROM conversations WHERE turn < 4",
    "convs": "SELECT DISTINCT conv_id, conv_id % 10 AS user_id FROM conversations WHERE conv_id % 6 <> 0",
    "known": "SELECT message_id, conv_id, user_id FROM messages JOIN convs USING (conv_id)",
}


@query(V.sql("""SELECT event_id, message_id, value, conv_id, user_id FROM feedback LEFT JOIN known USING (message_id)""", **_FEEDBACK))
def message_feedback(spark, sf_dir):
    """Feedback with the conversation and user of its message, which are null where these are unknown."""
    e, c = V.table(spark, sf_dir, "events"), V.table(spark, sf_dir, "conversations")
    feedback = e.where("event_type = 'click'").select("event_id", (F.col("event_id") % 997 * 3).alias("message_id"), "value")
    messages = c.where("turn < 4").select((F.col("conv_id") * 4 + F.col("turn")).alias("message_id"), "conv_id")
    known, lost = lists.feedback_rows(feedback, messages, c.where("conv_id % 6 <> 0").select("conv_id", (F.col("conv_id") % 10).alias("user_id")).distinct())
    return known.select("event_id", "message_id", "value", "conv_id", "user_id").unionByName(lost, allowMissingColumns=True)


_ALERTS = {
    "alerts": "SELECT event_id AS alert_id, event_id % 5 = 0 AS resolved FROM events WHERE event_type = 'error'",
    "tasks": "SELECT o_orderkey AS task_id, ['open', 'processing', 'done', 'rejected'][o_orderkey % 4 + 1] AS status, o_orderdate AS updated_at FROM orders",
    "hit": "SELECT alert_id FROM alerts WHERE alert_id % 3 = 0",
    "closed": "SELECT DISTINCT o_orderkey AS task_id FROM orders JOIN hit ON o_orderkey // 2 = alert_id",
}


@query(V.sql("""SELECT 'task' AS kind, task_id AS id, CASE WHEN c THEN 'done' ELSE status END AS state, CASE WHEN c THEN timestamp '2024-07-01' ELSE updated_at END AS updated_at
    FROM (SELECT t.*, closed.task_id IS NOT NULL AND status IN ('open', 'processing') AS c FROM tasks t LEFT JOIN closed USING (task_id))
    UNION ALL SELECT 'alert', alert_id, CASE WHEN resolved OR alert_id % 3 = 0 THEN 'resolved' ELSE 'open' END, NULL FROM alerts""", **_ALERTS))  # fmt: skip
def resolved_alerts(spark, sf_dir):
    """Alerts and their linked tasks after some alerts are resolved."""
    i, k = F.col("event_id"), F.col("o_orderkey")
    alerts = V.table(spark, sf_dir, "events").where("event_type = 'error'").select(i.alias("alert_id"), (i % 5 == 0).alias("resolved"))
    orders = V.table(spark, sf_dir, "orders")
    states = F.array(*map(F.lit, ("open", "processing", "done", "rejected")))
    tasks = orders.select(k.alias("task_id"), F.element_at(states, (k % 4 + 1).cast("int")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    links = orders.select(F.floor(k / 2).alias("alert_id"), k.alias("task_id"))
    a, t = versions.resolve_alerts(alerts, tasks, alerts.where("alert_id % 3 = 0"), links, V.as_of())
    a = a.select(F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), F.when(F.col("resolved"), "resolved").otherwise("open").alias("state"), F.lit(None).cast("timestamp").alias("updated_at"))
    return t.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("status").alias("state"), "updated_at").unionByName(a)


_GAPS = {"gaps": "SELECT concat(intent, '-', conv_id % 40) AS query_key, count(*) AS n, max(created_at) AS last_asked_at, CASE WHEN sum(turn) % 3 = 0 THEN 'accepted' ELSE 'open' END AS status FROM query_log_v GROUP BY 1"}


@query(V.sql("SELECT * FROM gaps WHERE status = 'open' ORDER BY n DESC, last_asked_at DESC, query_key LIMIT 20", "query_log_v", **_GAPS))
def top_open_gaps(spark, sf_dir):
    """The most asked open gaps."""
    key = F.concat(F.col("intent"), F.lit("-"), F.col("conv_id") % 40)
    status = F.when(F.sum("turn") % 3 == 0, "accepted").otherwise("open")
    gaps = V.query_log_v(spark, sf_dir).groupBy(key.alias("query_key")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_asked_at"), status.alias("status"))
    return lists.gaps_listed(gaps, 20, status="open")


#: Texts behind a line with a clause, a standard's code and words of duty, which the given texts lack.
_CODE = "(?i)((?:GB/T|GBT|GB|JGJ)\\s*\\d{1,5}(?:\\.\\d+)?\\s*[-—]\\s*\\d{4})"
_ATTRIBUTES = {
    "d0": """SELECT doc_id, coalesce(text, '') AS body, concat(CASE WHEN doc_id % 3 <> 0 THEN concat('第', doc_id % 12 + 1, '.', doc_id % 9, '.2条 ') ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN concat('gb/T ', 50000 + doc_id % 900, ' — 2014 ') ELSE '' END,
        CASE WHEN doc_id % 5 = 0 THEN concat('JGJ ', doc_id % 90 + 1, '-2008 ') ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '严禁 ' ELSE '' END, coalesce(text, '')) AS text, concat('clause ', doc_id % 12 + 1, '.', doc_id % 7, '.2') AS q FROM documents""",
    "d1": f"SELECT *, {_CLEAN('text')} AS t, regexp_extract_all(text, '{_CODE}', 1) AS codes FROM d0",
    "d2": "SELECT doc_id, t, string_agg(s, '' ORDER BY k) FILTER (ends <= 200) AS buf FROM (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS ends FROM (SELECT doc_id, t, unnest(p) AS s, unnest(range(len(p))) AS k FROM (SELECT doc_id, t, regexp_extract_all(t, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$') AS p FROM d1))) GROUP BY doc_id, t",
}


@query(V.sql(f"""SELECT doc_id, coalesce(regexp_replace(regexp_replace(translate(upper(codes[1]), '—', '-'), '\\s+', ' ', 'g'), '\\s*-\\s*', '-', 'g'), '') AS code, list_transform(codes, lambda x: regexp_replace(x, '\\s+', '', 'g')) AS codes,
    regexp_extract(trim(substring(text, 1, 60)), '^第?(\\d{{1,2}}(?:\\.\\d{{1,3}}){{1,3}})', 1) AS clause, regexp_matches(substring(text, 1, 150), '必须|严禁|不得|禁止') AS mandatory,
    CASE WHEN length(t) <= 200 THEN t ELSE concat({_TRIM("CASE WHEN coalesce(buf, '') <> '' THEN buf ELSE substring(t, 1, 200) END")}, '…') END AS summary,
    sha256(CASE WHEN doc_id % 6 = 0 OR starts_with(text, '第2.') THEN text ELSE concat('【a > 第2.】', chr(10), text) END) AS sectioned,
    CASE WHEN contains(text, concat(doc_id % 12 + 1, '.', doc_id % 7, '.2')) THEN 0.25::double ELSE 0.0::double END AS number_bonus,
    CASE WHEN len(list_filter(range(1, length(q) - 2), lambda i: contains(lower(text), substring(q, i::int, 4)))) > 0 THEN 4 / 6.0::double WHEN len(list_filter(range(1, length(q) - 1), lambda i: contains(lower(text), substring(q, i::int, 3)))) > 0 THEN 0.5::double
        WHEN len(list_filter(range(1, length(q)), lambda i: contains(lower(text), substring(q, i::int, 2)))) > 0 THEN 2 / 6.0::double ELSE 0.0::double END AS phrase, sha256(concat(q, '|{{"doc":', doc_id, '}}')) AS request
    FROM d1 JOIN d2 USING (doc_id, t)""", **_ATTRIBUTES))  # fmt: skip
def text_attributes(spark, sf_dir):
    """Codes, clause, duty, summary, section and query bonuses of texts behind a line of a standard."""
    i, no = F.col("doc_id"), F.lit("")
    body = T.text_or_empty(F.col("text"))
    head = [F.when(i % 3 != 0, F.concat(F.lit("第"), i % 12 + 1, F.lit("."), i % 9, F.lit(".2条 "))).otherwise(no), F.when(i % 2 == 0, F.concat(F.lit("gb/T "), 50000 + i % 900, F.lit(" — 2014 "))).otherwise(no)]
    head += [F.when(i % 5 == 0, F.concat(F.lit("JGJ "), i % 90 + 1, F.lit("-2008 "))).otherwise(no), F.when(i % 4 == 0, "严禁 ").otherwise(no)]
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(*head, body).alias("text"), F.concat(F.lit("clause "), i % 12 + 1, F.lit("."), i % 7, F.lit(".2")).alias("q"))
    text, q = F.col("text"), F.col("q")
    path = F.when(i % 6 != 0, "a > 第2.")
    return d.select(
        "doc_id", T.standard_code(text).alias("code"), T.standard_codes(text).alias("codes"), T.clause_no(text).alias("clause"), T.is_mandatory(text).alias("mandatory"), T.summary(text).alias("summary"),
        F.sha2(T.with_section(path, text), 256).alias("sectioned"), T.number_hit(q, text).alias("number_bonus"), T.phrase_hit(q, text).alias("phrase"), T.request_key(q, F.struct(i.alias("doc"))).alias("request"),
    )


@query(V.sql("SELECT i.doc_id, issue_type, severity, coalesce(title, '') AS doc_title FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, issue_type, severity FROM issues) i LEFT JOIN document_v d ON d.doc_id = i.doc_id", "document_v", issues=_TASKS["issues"]))
def titled_issues(spark, sf_dir):
    """Issues with the title of their document, some of which are gone or not named."""
    d, i = V.document_v(spark, sf_dir), F.col("doc_id")
    old = F.col("governance_status") == "deprecated"
    issues = d.where(old | (F.col("summary") == "")).select(
        F.when(i % 6 == 0, None).when(i % 13 == 0, -i - 1).otherwise(i).alias("doc_id"), F.when(old, "expired").otherwise("no_summary").alias("issue_type"), F.when(old | (i % 2 == 0), "high").otherwise("low").alias("severity"),
    )
    return lists.with_titles(issues, d)


_MEANS = "SELECT avg(score) AS score, avg(high_count) AS high, count(*)::double AS n FROM reports WHERE kb_id % 2 = "


@query(V.sql("""SELECT *, CASE WHEN min(delta) OVER () < -0.02 THEN 'regressed' WHEN max(delta) OVER () > 0.02 THEN 'improved' ELSE 'ok' END AS status
    FROM (SELECT metric, a.value AS current, b.value AS baseline, round(a.value - b.value, 4) AS delta FROM (UNPIVOT cur ON score, high, n INTO NAME metric VALUE value) a JOIN (UNPIVOT bas ON score, high, n INTO NAME metric VALUE value) b USING (metric))""",
    **_REPORTS, cur=_MEANS + "0", bas=_MEANS + "1"))
def baseline_comparison(spark, sf_dir):
    """Means of the reports of some knowledge bases beside those of the others, as a run beside its baseline."""
    r = _reports(spark, sf_dir)
    means = lambda k: r.where(F.col("kb_id") % 2 == k).agg(F.avg("score").alias("score"), F.avg("high_count").alias("high"), F.count("*").cast("double").alias("n"))
    return evaluate.baseline_status(means(0), means(1), ["score", "high", "n"])


@query(V.sql("SELECT *, recall < 0.7 AS low FROM (SELECT intent, count(*) AS n, round(avg(least(1.0, hit_count * confidence)), 4) AS recall FROM query_log_v GROUP BY intent)", "query_log_v"))
def recall_by_intent(spark, sf_dir):
    """Mean worth of each intent's answers, and whether it is low."""
    log = V.query_log_v(spark, sf_dir).withColumn("query_id", F.concat_ws("-", "conv_id", "turn"))
    return quality.intent_recall(log.select("query_id", F.least(F.lit(1.0), F.col("hit_count") * F.col("confidence")).alias("recall_5")), log)
