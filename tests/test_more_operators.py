"""Lists, versions, inspection, evaluation, answers and sinks on small frames with values worked out by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import answers, evaluate, lists, quality, search, versions
from corpuslens.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_mended_scalars(spark):
    one = lambda x, c: frame(spark, [(x,)], "t string").select(c).first()[0]
    t = F.col("t")
    assert one("a\n-- 12 --\nb", T.clean_text(t)) == "a\n\nb" and one("GB 50204 - 2015", T.standard_code(t)) == "GB 50204-2015"
    assert one("see [2015] and [2]", T.citation_marks(t)) == [2] and one("?!", T.report_key(t)) == "?!" and one("b a b cc bb", T.top_keywords(t, 1)) == ["cc"]
    assert one(None, T.request_key(t, F.struct(F.lit(1).alias("a")))) is not None


def test_lists(spark):
    k = frame(spark, [(1, "Alpha", 5, "x"), (2, None, 7, "x"), (3, "alphabet", 7, "y")], "kb_id int, name string, created_at int, domain string")
    assert [r["kb_id"] for r in lists.listed(k, "kb_id", "ALPHA", ("name",), "created_at").collect()] == [3, 1]
    assert [r["kb_id"] for r in lists.listed(k, "kb_id", newest="created_at", domain="x").collect()] == [2, 1] and lists.at_key(k, "kb_id", 9).count() == 0
    g = frame(spark, [("a", 2, 1, "open"), ("b", 5, 1, "open"), ("c", 9, 1, "done"), ("d", 5, 3, "open")], "query_key string, n int, last_asked_at int, status string")
    assert [r["query_key"] for r in lists.gaps_listed(g, 2, status="open").collect()] == ["d", "b"]
    assert lists.in_scope(k, k.where("false")).count() == 0 and lists.in_scope(k, k.where("kb_id = 2")).count() == 1
    msgs, conv = frame(spark, [(1, 10), (2, 11)], "message_id int, conv_id int"), frame(spark, [(10, "u")], "conv_id int, user_id string")
    ok, bad = lists.feedback_rows(frame(spark, [(1, 1), (2, -1), (3, 1)], "message_id int, rating int"), msgs, conv)
    assert got(ok, "message_id", "user_id") == [(1, "u")] and got(bad, "message_id") == [(2,), (3,)]
    users = frame(spark, [("a", "admin", None), ("e", "editor", "t1"), ("v", "viewer", "t1"), ("n", None, None)], "user_id string, role string, tenant_id string")
    kbs = frame(spark, [(1, "public", "t2", None), (2, "tenant", "t1", None), (3, "private", "t1", ["viewer"])], "kb_id int, visibility string, tenant_id string, allowed_roles array<string>")
    assert got(lists.writable(users, kbs), "user_id", "kb_id") == [("a", 1), ("a", 2), ("a", 3), ("e", 1), ("e", 2), ("v", 3)]
    assert got(lists.visible(kbs, "t1"), "kb_id") == [(1,), (2,), (3,)] and got(lists.visible(kbs, None), "kb_id") == [(1,)]
    r = frame(spark, [(1, "k", 1, 90.0, 3, 0, {"a": 1}), (2, "k", 2, 70.0, 4, 1, {"a": 2, "b": 1})], "report_id int, kb_id string, created_at int, score double, issue_count int, high_count int, issue_counts map<string,int>")
    assert got(lists.latest(r, ["kb_id"]), "report_id") == [(2,)] and got(lists.issue_share(r), "issue_type", "n", "share") == [("a", 3, 0.75), ("b", 1, 0.25)]
    x = lists.kpis(r, frame(spark, [(False,), (True,)], "resolved boolean")).first()
    assert (x["score"], x["band"], x["open_alerts"]) == (70.0, "fair", 1)
    assert got(lists.flat_metrics(frame(spark, [({"1": 0.5},)], "recall map<string,double>"), "recall"), "recall_1", "recall_3") == [(0.5, 0.0)]
    assert got(lists.with_titles(frame(spark, [(1,), (2,)], "doc_id int"), frame(spark, [(1, "t")], "doc_id int, title string")), "doc_id", "doc_title") == [(1, "t"), (2, "")]


def test_versions(spark):
    d = frame(spark, [(1, "k", False), (2, "k", True), (3, "m", None)], "doc_id int, kb_id string, is_deleted boolean")
    new, members = versions.checkpoint(d, frame(spark, [("k", 4)], "kb_id string, version_no int"))
    assert got(new, "kb_id", "version_no", "n_docs") == [("k", 5, 1), ("m", 1, 1)] and got(members, "kb_id", "doc_id") == [("k", 1), ("m", 3)]
    docs, chunks = versions.cascade(d, frame(spark, [(1, 0, False), (1, 1, False), (3, 0, False)], "doc_id int, seq int, is_deleted boolean"), d.where("doc_id = 1"))
    assert got(docs.where("is_deleted"), "doc_id") == [(1,), (2,)] and chunks.where("is_deleted").count() == 2
    a = frame(spark, [("a", False), ("b", False)], "alert_id string, resolved boolean")
    t = frame(spark, [(1, "open", None), (2, "closed", None), (3, "open", None)], "task_id int, status string, updated_at timestamp")
    links = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "alert_id string, task_id int")
    a2, t2 = versions.resolve_alerts(a, t, a.where("alert_id = 'a'"), links, F.lit(datetime(2024, 1, 1)))
    assert got(a2, "alert_id", "resolved") == [("a", True), ("b", False)] and got(t2, "task_id", "status") == [(1, "done"), (2, "closed"), (3, "open")]
    own = versions.with_assignee(frame(spark, [(1, ""), (2, "z")], "doc_id int, assignee string"), frame(spark, [(1, "o"), (2, "p")], "doc_id int, owner string"))
    assert got(own, "doc_id", "assignee") == [(1, "o"), (2, "z")]


def test_inspection_and_rates(spark):
    i = frame(spark, [(1, "tiny_chunk", "low"), (2, "zero_vector", "high"), (3, "tiny_chunk", "low")], "doc_id int, issue_type string, severity string")
    counts, kept = quality.inspection(i, 3, 2)
    assert [r["doc_id"] for r in kept.collect()] == [2, 1] and got(quality.suggestions(counts), "issue_type", "n") == [("tiny_chunk", 2), ("zero_vector", 1)]
    q = frame(spark, [(1, 1.0), (2, 0.0)], "query_id int, recall_5 double")
    assert got(quality.intent_recall(q, frame(spark, [(1, "a"), (2, "a")], "query_id int, intent string")), "intent", "recall", "low") == [("a", 0.5, True)]
    gold = frame(spark, [(1, False), (2, False), (3, True), (4, True)], "query_id int, negative boolean")
    r = evaluate.run_rates(gold, q, frame(spark, [(1, False), (2, True), (3, False)], "query_id int, rejected boolean")).first()
    assert (r["hit_rate"], r["full_hit_rate"], r["below_floor_rate"], r["correct_rejection_rate"]) == (0.5, 0.5, 0.5, 0.5)
    c = evaluate.corpus_golden(frame(spark, [("d", ["q1", "q2"]), ("e", ["q3"])], "doc_id string, queries array<string>"), frame(spark, [("d", "c2"), ("d", "c1")], "doc_id string, chunk_id string"))
    assert got(c, "query_id", "relevant") == [("d-1", ["c1", "c2"]), ("d-2", ["c1", "c2"]), ("e-1", [])]


def test_answers(spark):
    cols = "query_id int, doc_id int, rank int, content string, title string, standard_code string, section_path string, clause_no string, page_no int, governance_status string"
    rows = [(1, 1, 1, "x" * 500, "t", "GB1", "s", "1.1", 2, "deprecated"), (1, 2, 2, "x" * 500, None, None, None, None, None, None), (1, 3, 3, "y" * 900, "u", "", "", "", 0, "valid"), (1, 4, 4, " ", "v", "", "", "", 0, "valid")]
    b = {r["index_no"]: r for r in answers.context_blocks(frame(spark, rows, cols), budget=1000).collect()}
    assert b[1]["block"].startswith("[1] 《t》（GB1） | 章节：s | 条文：1.1 | 第2页 | ⚠已废弃，仅供参考\nxxx") and set(b) == {1, 2} and b[2]["doc_id"] == 3 and b[2]["block"].endswith("…")
    q = frame(spark, [(1, "curing of concrete"), (2, "other")], "query_id int, query string")
    blocks = frame(spark, [(1, 1, "[1] 《t》\n【a】Nothing of interest here. Concrete needs curing for 7d at least; short"), (1, 2, "[2] 《u》\nConcrete needs curing for 7d at least;")], "query_id int, index_no int, block string")
    a = {r["query_id"]: r["answer"] for r in answers.extracted(q, blocks, "。；！？;!?.").collect()}
    assert "- Concrete needs curing for 7d at least; [1]" in a[1] and "[2]" not in a[1] and a[2] == answers.NO_CONTEXT
    f = frame(spark, [(1, 1, 0.5), (1, 2, 0.4)], "query_id int, doc_id int, fusion_score double")
    u = answers.with_sub_queries(f, frame(spark, [(1, 2, 0.9, 1), (1, 3, 0.5, 1), (1, 3, 0.9, 2)], "query_id int, doc_id int, fusion_score double, n int"))
    assert got(u, "doc_id", "fusion_score", "rank") == [(1, 0.5, 1), (2, 0.4, 3), (3, 0.45, 2)]
    codes = answers.boost_codes(f.withColumn("standard_code", F.when(F.col("doc_id") == 2, "gb 50204-2015")), frame(spark, [(1, ["GB50204-2015"])], "query_id int, codes array<string>"))
    assert got(codes, "doc_id", "fusion_score", "rank") == [(1, 0.5, 2), (2, 0.54, 1)]
    w = frame(spark, [("裂缝 它", "桥", None, "basement basement walls"), (None, None, None, None)], "query string, project_type string, region string, last_user string")
    assert got(answers.rewritten(w), "rewritten") == [("",), ("裂缝 它 开裂 龟裂 裂纹 桥 basement walls",)]
    m = "query_id int, n_intent int, n_broad int, top_fusion double, top_broad double, top_rerank double, mean_bm25 double, mean_vector double, intent_confidence double, most_of_one int"
    rows = [(1, 0, 0, None, None, None, None, None, 0.9, 0), (2, 0, 3, None, 0.9, 0.5, None, None, 0.9, 0), (3, 5, 5, 0.5, 0.5, 0.5, 0.9, 0.5, 0.9, 3), (4, 5, 5, 0.9, 0.9, 0.9, 0.5, 0.5, 0.9, 1), (5, 5, 5, 0.9, 0.9, 0.9, 0.9, 0.5, 0.9, 1)]
    assert got(answers.attributed(frame(spark, rows, m)), "query_id", "verdict") == [(1, "missing_doc"), (2, "intent_misroute"), (3, "chunking_bad"), (4, "retrieval_ok"), (5, "rewrite_drift")]


def test_sinks(spark, tmp_path):
    g = frame(spark, [("g07", "old"), ("x", "kept")], "id string, query string")
    assert got(tables.add_golden(g, frame(spark, [(None, "b"), ("", "a"), ("x", "new")], "id string, query string")), "id", "query") == [("g07", "old"), ("g08", "a"), ("g09", "b"), ("x", "new")]
    assert tables.baseline_metrics(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "b.json").write_text('{"aggregated": {"mrr": 0.5, "note": "x"}}')
    assert got(tables.baseline_metrics(spark, f"{tmp_path}/b.json"), "metric", "value") == [("mrr", 0.5)]
    v = tables.upsert(frame(spark, [("a", "k", [1.0])], "chunk_id string, kb_id string, vector array<double>"), frame(spark, [("a", "k", [3.0, 4.0]), ("b", "m", [0.0])], "chunk_id string, kb_id string, vector array<double>"))
    assert got(v, "chunk_id", "vector") == [("a", [0.6, 0.8]), ("b", [0.0])] and got(tables.counts(tables.drop_kb(v, ["m"])), "kb_id", "n") == [("k", 1)]
    flat = frame(spark, [(1, "k", None), (2, "m", "t")], "id int, kb_id string, tenant_id string")
    assert tables.repartitioned(flat, f"{tmp_path}/parts") == (2, 2) and spark.read.parquet(f"{tmp_path}/parts").where("tenant_id = 'default'").count() == 1
    two = {"a": flat, "b": flat, "c": flat}
    assert tables.copy_tables(two, f"{tmp_path}/copy", ("c",)) == {"a": "copied", "b": "copied", "c": "excluded"}
    assert tables.copy_tables(two, f"{tmp_path}/copy", ("c",))["a"] == "not empty" and spark.read.parquet(f"{tmp_path}/copy/a").count() == 2
    tables.append_rows(flat.fillna("t"), f"{tmp_path}/log")
    tables.append_rows(flat.fillna("t"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_dense_search(spark):
    """Blocks of queries and parts of batches give what all pairs give; a zero vector has cosine 0 with all."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 8)), 3)
    x[7] = 0
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    want = []
    for q in range(0, 60, 5):
        best = sorted((-round(float(u[q] @ u[i]), 6) + 0.0, i) for i in range(60) if i != q)[:3]
        want += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    queries = v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    for block, rows in ((4096, 2048), (5, 7)):
        assert got(search.dense_search(v.repartition(3), queries, 3, block=block, rows=rows), "query_id", "vec_id", "rank") == sorted(want, key=str)
    assert search.dense_search(v, queries.where("false")).count() == 0


def test_granted_totals_equal_the_pairs_and_make_none(spark):
    from corpuslens.operators import governance, lists

    users = spark.createDataFrame([(1, "admin", "t1"), (2, "editor", "t1"), (3, "viewer", None), (4, None, "t2"), (5, None, None), (6, "editor", "t2")], "user_id long, role string, tenant_id string")
    kbs = spark.createDataFrame([(i, ["public", "tenant", "private", None][i % 4], ["t1", "t2", None][i % 3], [["viewer", "viewer"], ["editor", "viewer"], None, [None, "editor"]][i % 4 - i % 2]) for i in range(48)], "kb_id long, visibility string, tenant_id string, allowed_roles array<string>")
    for keyed, pairs in ((governance.readers(users), governance.accessible(users, kbs)), (lists.writers(users), lists.writable(users, kbs))):
        got = {tuple(r) for r in governance.granted_totals(keyed, kbs).collect()}
        want: dict = {}
        for u, k in pairs.collect():
            want.setdefault(u, []).append(k)
        assert got == {(u, len(k), min(k), max(k)) for u, k in want.items()}
