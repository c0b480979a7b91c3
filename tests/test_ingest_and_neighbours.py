"""Pages, tables, ingest from end to end, roll back, nearest similar vectors, and the periodic inspection."""

import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import governance, ingest, neighbours, versions
from corpuslens.streaming import jobs

LONG = "Concrete shall be cured for seven days in the shade. " * 3


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_pages_and_tables(spark):
    pages = spark.createDataFrame([(1, 2, "5.2 Curing\n\nx\n\n" + LONG), (1, 1, "附录 A Terms\n\nSome words here."), (2, 1, None), (3, 1, "- 12 -")], "doc_id long, page_no int, text string")
    b = ingest.page_blocks(pages)
    assert got(b, "doc_id", "pos", "page_no", "block_type", "heading_level", "clause_no") == [
        (1, 0, 1, "heading", 1, ""), (1, 1, 1, "paragraph", None, ""), (1, 2, 2, "heading", 2, "5.2"), (1, 3, 2, "paragraph", None, ""),
    ]
    c = ingest.chunks_of(b).orderBy("seq").collect()
    assert [(r["page_no"], r["clause_no"], r["section_path"]) for r in c] == [(2, "5.2", "附录 A Terms > Curing")]

    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | some cell of this row |" for i in range(60))
    rows = [(1, 0, LONG, "paragraph", None, None, ""), (1, 1, table, "table", None, None, ""), (1, 2, LONG, "paragraph", None, None, "")]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, text string, block_type string, heading_level int, heading_title string, clause_no string")
    c = ingest.chunks_of(blocks, size=200).orderBy("seq").collect()
    assert [r["content"].startswith("| a") for r in c] == [False, True, False] and c[1]["content"].count("\n") == 61  # whole, and apart from its neighbours


def test_ingest_reindex_and_roll_back(spark):
    batch = spark.createDataFrame([(1, "k", "# One\n\nGB 50204 - 2015 " + LONG), (2, "k", "# One\n\nGB 50204 - 2015 " + LONG), (3, "k", "tiny"), (4, "k", None), (5, "k", "# Five\n\n" + LONG)], "doc_id long, kb_id string, text string")
    stored = batch.where("doc_id = 5").select("kb_id", F.sha2("text", 256).alias("file_hash"))
    out = ingest.ingested(batch, stored)
    assert got(out["documents"], "doc_id", "status", "chunk_count", "standard_code") == [(1, "ready", 1, "GB 50204-2015"), (3, "failed", 0, ""), (4, "failed", 0, "")]
    assert got(out["chunks"], "chunk_id") == [("1-0",)] and {r["chunk_id"] for r in out["vectors"].collect()} == {r["chunk_id"] for r in out["postings"].collect()} == {"1-0"}
    assert got(ingest.ingested(batch.where("false"), stored)["documents"], "doc_id") == []

    docs = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "other", False)], "doc_id long, kb_id string, is_deleted boolean")
    chunks = spark.createDataFrame([("1-0", 1, "k", LONG, False), ("2-0", 2, "k", "second text", True), ("3-0", 3, "other", "third text", False)], "chunk_id string, doc_id long, kb_id string, content string, is_deleted boolean")
    v, p = ingest.index_rows(chunks.where("NOT is_deleted"))
    d, c, v, p = versions.rolled_back(docs, chunks, v, p, spark.createDataFrame([("k", 2)], "kb_id string, doc_id long"))
    assert got(d, "doc_id", "is_deleted") == [(1, True), (2, False), (3, False)] == got(c, "doc_id", "is_deleted")
    assert {r["chunk_id"] for r in v.collect()} == {r["chunk_id"] for r in p.collect()} == {"2-0", "3-0"}


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # buckets are dealt in groups
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    x = np.vstack([base, base[:20] + 0.1 * rng.standard_normal((20, 24)), base[3] + 0.15 * rng.standard_normal((100, 24)), np.repeat(base[7:8], 30, axis=0), np.zeros((2, 24))])
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<double>")
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(i, int(s[i].argmax())) for i in range(len(x)) if s[i].max() >= 0.92 and s[i].argmax() > i}
    found = set(got(neighbours.near_duplicate_issues(neighbours.nearest_similar(df)), "vec_id", "neighbour"))
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * len(want)
    lone = got(neighbours.orphans(df, least=0.5, refs=5), "vec_id")
    assert lone == sorted(((i,) for i in range(len(x)) if s[i].max() < 0.5), key=str) and (190,) in lone
    empty = df.where("false")
    assert neighbours.nearest_similar(empty).count() == 0 == neighbours.orphans(empty).count()


def test_dashboard_and_report_without_rows(spark):
    log = spark.createDataFrame([], "created_at timestamp, answered boolean, hit_count int, confidence double, latency_ms int")
    gaps, tasks = spark.createDataFrame([], "status string, intent string"), spark.createDataFrame([("open",), ("done",)], "status string")
    start = F.lit("2024-01-01").cast("timestamp")
    board = {(r["measure"], r["name"]): r["value"] for r in governance.dashboard(gaps, tasks, log, start).collect()}
    assert board == {("tasks_by_status", "open"): 1, ("tasks_by_status", "done"): 1, ("gap_total", ""): 0, ("open_gaps", ""): 0, ("task_total", ""): 2, ("pending_tasks", ""): 1, ("total_queries", ""): 0, ("answer_rate", ""): 0}
    some = spark.createDataFrame([], "created_at timestamp, rating int")
    r = governance.operation_report(some, some, log, tasks, some, start).first()
    assert r["total_queries"] == 0 and r["suggestions"] == ["add documents"]


def test_periodic_inspection(spark, tmp_path):
    schema = "doc_id long, seq int, kb_id string, section_path string, clause_no string, char_count int"
    good, bad = (1, 0, "k", "a", "", 100), (2, 0, "k", "", "", 2000)
    for rows in ([good, bad, bad], [good, good]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.periodic_inspection(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    reports = spark.read.parquet(f"{tmp_path}/out/reports")
    assert got(reports, "batch", "kb_id", "score", "issue_count") == [(0, "k", 46.7, 4), (1, "k", 100.0, 0)]
    assert got(spark.read.parquet(f"{tmp_path}/out/alerts"), "batch", "alert_type") == [(0, "low_score")]


def test_vectors_by_digests_of_whole_batches():
    """Places and signs of features of any length, in one pass, are those of MD5."""
    from hashlib import md5

    import numpy as np

    from corpuslens.functions import vectors

    words = ["a", "混凝土", "x" * 55, "y" * 56, "z" * 200, "", "w" * 54] + [f"w{i}" for i in range(20_000)]
    raw = "".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words])
    head, bit = vectors.md5_heads(raw, np.cumsum(sizes) - sizes, sizes)
    want = [md5(w.encode()).digest() for w in words]
    assert head.tolist() == [int.from_bytes(h[:4]) for h in want] and bit.tolist() == [h[4] % 2 for h in want]


def test_a_long_text_is_cleaned_once_and_not_for_each_chunk(spark):
    """What is computed beside a generator is computed for each of its rows: the text must be a column before."""
    from corpuslens.operators import ingest

    docs = spark.createDataFrame([(1, "One sentence of some words. " * 200)], "doc_id long, text string")
    plan = ingest.chunks(docs, ends=".")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode(packs")]
    assert "array_join" not in above and "whole" not in above
    assert ingest.chunks(docs, ends=".").count() > 10


def test_keywords_leave_the_task_only_and_rows_of_one_id_count_together(spark):
    from corpuslens.operators import ingest

    rows = [(1, "beta alpha alpha the gamma"), (2, "x 1"), (3, None), (4, "one two"), (4, "two three"), (None, "nil nil own"), (None, "own own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["keywords"] for r in ingest.keywords(docs, 2).collect()}
    assert got == {1: ["alpha", "gamma"], 4: ["two", "three"], None: ["own", "nil"]}
    plan = ingest.keywords(docs.where("doc_id < 4"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_summary_takes_whole_sentences(spark):
    from pyspark.sql import functions as F

    from corpuslens.functions import text as T

    texts = ["short", "Ab! " * 10, "x" * 30, None, "Hi! " + "y" * 30, "12345! 7890! 2"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.summary(F.col("t"), 12)).collect()]
    assert got == ["short", "Ab! Ab! Ab!…", "x" * 12 + "…", "", "Hi!…", "12345! 7890!…"]
