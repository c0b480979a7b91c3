"""Operators on small frames with values worked out by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import evaluate, governance, ingest, intents, quality, reports, search
from corpuslens.sources import tables
from corpuslens.streaming import jobs


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_codes_and_clauses(spark):
    t = F.col("t")
    assert one(spark, "按JGJ130-2011执行", T.standard_code(t))[0] == "JGJ130-2011" and one(spark, "没有编号的普通文本", T.standard_code(t))[0] == ""
    assert one(spark, "7.4.2 采用…", T.clause_no(t))[0] == "7.4.2" and one(spark, "普通段落内容", T.clause_no(t))[0] == ""
    assert one(spark, "严禁在基坑…", T.is_mandatory(t))[0] and not one(spark, "本条为一般性说明…", T.is_mandatory(t))[0]
    assert one(spark, "see [2], [1] and [2]", T.citation_marks(t))[0] == [2, 1]
    assert one(spark, "GB 50204-2015 与 JGJ 130—2011", T.standard_codes(t))[0] == ["GB50204-2015", "JGJ130—2011"]


def test_tokens(spark):
    assert one(spark, "The C40 混凝土 is x 3.5 well-made", T.tokenize(F.col("t")))[0] == ["40", "混凝土", "3.5", "well-made"]
    assert one(spark, None, T.tokenize(F.col("t")))[0] == []


def test_clean_and_summary(spark):
    assert one(spark, " a  b\n\n\n\nc\n- 12 -\nd ", T.clean_text(F.col("t")))[0] == "a b\n\nc\n\nd"
    assert one(spark, "One. Two! " * 30, T.summary(F.col("t"), 25))[0].endswith("…")
    assert one(spark, "short", T.summary(F.col("t")))[0] == "short"


def test_lexical(spark):
    r = spark.createDataFrame([("abcd 1.2", "xx abcd 1.2 不得")], "q string, d string").select(T.phrase_hit(F.col("q"), F.col("d")), T.number_hit(F.col("q"), F.col("d"))).first()
    assert abs(r[0] - 4 / 6) < 1e-9 and r[1] == 0.25


def test_fusion(spark):
    v, b = (spark.createDataFrame([(1, 7, s, r)], "query_id int, doc_id int, score double, rank int") for s, r in ((0.8, 1), (0.5, 2)))
    assert abs(search.fuse(v, b).first()["fusion_score"] - 0.928066) < 1e-6


def test_floor(spark):
    rows = [(1, 0.5), (1, 0.34), (1, 0.1), (2, 0.5), (2, 0.3), (3, 0.44), (3, 0.44)]
    got = {r["query_id"]: r["rejected"] for r in search.relevance_floor(spark.createDataFrame(rows, "query_id int, final_score double")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, doc_id string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3)], "query_id int, doc_id string, rank int")
    m = {r["query_id"]: r for r in evaluate.ranking_metrics(ranked, gold).collect()}
    assert (m[1]["mrr"], m[1]["recall_1"], m[1]["recall_3"], m[1]["ndcg_3"]) == (0.5, 0.0, 1.0, 0.7) and m[2]["mrr"] == 0.0
    cur, base = (spark.createDataFrame([(x,)], "mrr double") for x in (0.5, 0.521))
    assert evaluate.baseline_status(cur, base, ["mrr"]).first()["status"] == "regressed"


def test_chunks(spark):
    text = "# One\n\n" + "alpha beta gamma。" * 60 + "\n\n## Two\n\n7.4.2 必须 do it\n\n# Three\n\n" + "tail words here " * 5
    c = ingest.chunks(spark.createDataFrame([(1, text), (2, None), (3, "tiny")], "doc_id long, text string")).orderBy("doc_id", "seq").collect()
    assert {r["doc_id"] for r in c} == {1} and [r["seq"] for r in c] == list(range(len(c)))
    assert {r["section_path"] for r in c} >= {"One", "Three"} and any(r["clause_no"] == "7.4.2" and r["is_mandatory"] for r in c)
    assert all(r["char_count"] == len(r["content"]) <= 600 + 100 + 20 for r in c)


def test_scores(spark):
    issues = spark.createDataFrame([("high",), ("medium",), ("low",)], "severity string")
    assert quality.score(issues, 10).first()["score"] == 80.0
    docs = spark.createDataFrame([(i, False) for i in range(4)], "doc_id int, is_deleted boolean")
    assert governance.health_score(spark.createDataFrame([("high",), ("high",)], "severity string"), docs).first()["score"] == 64.0
    r = spark.createDataFrame([(1, "t", "k", 1, 95.0, 0), (2, "t", "k", 2, 79.9, 1)], "report_id int, tenant_id string, kb_id string, created_at int, score double, high_count int")
    assert sorted(x["alert_type"] for x in quality.alerts(r).collect()) == ["low_score", "new_high_severity"]


def test_gaps(spark):
    at = datetime(2024, 1, 1)
    gaps = spark.createDataFrame([("alpha beta", 3, at, "rejected")], "query_key string, n long, last_asked_at timestamp, status string")
    asked = spark.createDataFrame([("beta alpha", at), ("new thing", at), ("thing new", at)], "query string, created_at timestamp")
    got = {r["query_key"]: (r["n"], r["status"]) for r in governance.capture_gaps(gaps, asked).collect()}
    assert got == {"alpha beta": (3, "rejected"), "new thing": (2, "open")}


def test_versions_and_access(spark):
    v, c = (spark.createDataFrame([(i,) for i in x], "doc_id int") for x in ((1, 2, 3), (2, 3, 4)))
    assert {tuple(r) for r in governance.version_diff(v, c).collect()} == {(1, "removed"), (4, "added")}
    u = spark.createDataFrame([(1, "viewer", "t1")], "user_id int, role string, tenant_id string")
    k = spark.createDataFrame([("a", "tenant", "t2", []), ("b", "public", "t2", []), ("c", "private", "t2", ["viewer"])], "kb_id string, visibility string, tenant_id string, allowed_roles array<string>")
    assert {r["kb_id"] for r in governance.accessible(u, k).collect()} == {"b", "c"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{i * i}\n" for i in range(45)) + ",\n")
    (tmp_path / "b.exe").write_text("no")
    got = tables.csv_tables(spark, f"{tmp_path}/a.csv").orderBy("block").collect()
    assert len(got) == 2 and got[0]["text"].startswith("| x | y |\n| --- | --- |\n| 0 | 0 |") and got[1]["text"].count("\n") == 6
    assert {r["path"][-5:]: r["reason"] for r in tables.admission(spark, str(tmp_path)).collect()} == {"a.csv": None, "b.exe": "suffix"}
    base = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, v string, updated_at string")
    changed = tables.apply_changes(base, spark.createDataFrame([(2, "c")], "id int, v string"), "id", F.lit("now"))
    assert {tuple(r) for r in changed.collect()} == {(1, "a", None), (2, "c", "now")}


def test_streams(spark, tmp_path):
    rows = [("alpha beta", "x", 1, 0.5, 10, True, datetime(2024, 1, 1, h)) for h in (0, 0, 1, 9)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "query string, intent string, hit_count int, confidence double, latency_ms int, answered boolean, created_at timestamp").coalesce(1).write.parquet(src)
    log = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = jobs.windowed_metrics(log).writeStream.format("memory").queryName("ops").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n_queries"] for r in spark.table("ops").collect()) == [1, 2]  # the last window is still open
    g = jobs.gap_capture(log, str(tmp_path / "gaps"), str(tmp_path / "c2"))
    g.awaitTermination(120)
    batch = governance.capture_gaps(spark.createDataFrame([], "query_key string, n long, last_asked_at timestamp, status string"), spark.read.parquet(src))
    assert spark.read.parquet(str(tmp_path / "gaps/v0")).collect() == batch.collect()


def test_intents(spark):
    q = ["JGJ130 规定的限值是多少", "裂缝的原因", "你好", "你好，今天的天气真的非常好我们出去", "参考类似的裂缝原因和缺陷的经验", "hello", None]
    got = intents.planned(intents.classified(spark.createDataFrame(list(enumerate(q)), "id int, query string"))).orderBy("id").collect()
    assert [r.intent for r in got] == ["spec_lookup", "quality_diagnosis", "chitchat", "unknown", "case_retrieval", "unknown", "unknown"]
    assert [r.intent_confidence for r in got] == [0.95, 0.94, 0.67, 0.3, 0.95, 0.3, 0.3]
    assert [r.top_k for r in got] == [14, 28, 0, 20, 24, 20, 20] and [r.need_retrieval for r in got][2] is False


def test_sub_queries_and_citations(spark):
    q = spark.createDataFrame([(1, "what is the limit? and who checks it；ok"), (2, "only one question"), (3, None)], "query_id int, query string")
    assert [tuple(r) for r in intents.sub_queries(q).collect()] == [(1, 1, "what is the limit"), (1, 2, "and who checks it")]
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "query_id int, rank int")
    a = spark.createDataFrame([(1, "see [2]"), (2, "none [7]")], "query_id int, answer string")
    assert sorted(map(tuple, intents.citations(c, a).collect())) == [(1, 2), (2, 1), (2, 2)]


def test_confidence_and_gap_tasks(spark):
    c = spark.createDataFrame([(1, 5, 0.8, "valid"), (1, 6, 0.4, "deprecated")], "query_id int, doc_id long, final_score double, governance_status string")
    a = spark.createDataFrame([(1, "beam load", "the beam [1]"), (2, "临边 safety", "")], "query_id int, query string, answer string")
    got = {r.query_id: r for r in intents.confidence(c, a).collect()}
    assert got[1].confidence == round((0.34 * 0.72 + 0.14 * 0.5 + 0.14 * 2 / 3 + 0.24 * 0.5 + 0.14 * 0.5) * 0.75, 4) and got[1].need_review
    assert got[2].confidence == 0 and got[2].level == "low" and got[2].need_review
    g = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9)], "query_key string, n int")
    assert sorted((r.query_key, r.priority) for r in intents.gap_tasks(g, g.where("query_key = 'c'")).collect()) == [("a", "high"), ("b", "medium")]


def test_pages(spark):
    d = spark.range(45).withColumnRenamed("id", "doc_id")
    last = reports.page_of(d, [F.desc("doc_id")], 3).collect()
    assert [r["doc_id"] for r in last] == [4, 3, 2, 1, 0] and (last[0]["total"], last[0]["pages"]) == (45, 3)
    assert reports.page_of(d, [F.col("doc_id")], 4).count() == 0 and reports.page_of(d.where("doc_id < 0"), [F.col("doc_id")]).count() == 0


def test_log_rows(spark):
    rows = [(1, "chitchat", 0, 0.0, False), (2, "unknown", 0, 0.9, False), (3, "unknown", 2, 0.9, True), (4, "unknown", 2, 0.9, None), (5, None, None, None, None)]
    got = {r["id"]: (r["answered"], r["is_gap"]) for r in reports.log_rows(spark.createDataFrame(rows, "id int, intent string, hit_count int, confidence double, rejected boolean")).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, True), 4: (True, False), 5: (False, True)}


def test_trend(spark):
    runs = spark.createDataFrame([(1, 0.1), (2, 0.70), (3, 0.75), (4, None), (5, 0.80)], "at int, mrr double")
    r = reports.trend(runs, "mrr", "at", 0.75, last=3).first()
    assert tuple(r) == (3, 0.70, 0.80, 0.1, 1, 1)
    assert tuple(reports.trend(runs.where("at > 9"), "mrr", "at", 0.75).first()) == (0, None, None, None, 0, 0)


def test_alert_tasks(spark):
    a = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "alert_id int, report_id int")
    t = spark.createDataFrame([(7, 1, 10), (8, None, 10), (9, 3, None), (6, None, None)], "task_id int, source_alert_id int, source_report_id int")
    assert sorted(map(tuple, reports.alert_tasks(a, t).collect())) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 9)]
