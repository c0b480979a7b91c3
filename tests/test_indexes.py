"""Stored indexes against the plain searches and fresh builds, and retrieval on odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import evaluate, retrieve, search, term_index, vector_index
from corpuslens.sources.sliced import shared_folder

WORDS = [f"w{i:02d}" for i in range(40)]


def made_docs(seed=1, n=160):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kb = draw.choice(["a", "a", "a", "b", "c"])  # one knowledge base holds most
        words = [draw.choice(WORDS[: draw.choice([3, 10, 40])]) for _ in range(draw.randrange(0, 30))]
        rows.append((kb, i, " ".join(words), draw.choice(["x", "y"])))
    return [*rows, ("a", 1000, None, "x"), ("a", 1001, "", "y"), ("d", 1002, "w00 w00", "x"), (None, 1003, "w00", "x"), ("b", 1004, "w01 w02", None)]


QUERIES = [(1, "w00 w01 w30"), (2, "w39"), (3, "w00 w00 w02"), (4, "nothing known"), (5, ""), (6, None), (7, " ".join(WORDS))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), "kb_id string, doc_id long, text string, domain string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


@pytest.fixture(scope="module")
def built(spark, docs):
    return term_index.build(docs, shared_folder(spark, "terms"), attributes=("domain",), slice_docs=20, range_docs=4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(docs, asked, k):
    return rows(search.bm25_search(docs.where("kb_id IS NOT NULL"), asked, k).select("query_id", "doc_id", "kb_id", "score", "rank"))


@pytest.mark.parametrize("k,first", [(1, 1), (3, 1), (5, 4), (200, 2)])
def test_term_index_equals_plain_search(built, docs, asked, k, first):
    assert rows(term_index.search(built, asked, k, first=first)) == plain(docs, asked, k)


def test_term_index_limits_by_row_and_many_slices(built, docs, asked):
    got = rows(term_index.search(built, asked.withColumn("k", (F.col("query_id") % 3 + 1).cast("int")), "k"))
    want = [r for k in (1, 2, 3) for r in plain(docs, asked.where(F.col("query_id") % 3 + 1 == k), k)]
    assert got == sorted(want, key=str)
    assert built.manifest().where("kb_id = 'a'").count() > 2


def test_term_index_scope_and_filters(spark, built, docs, asked):
    scope = spark.createDataFrame([(1, "a"), (1, "b"), (3, "b"), (7, "zz")], "query_id long, kb_id string")
    got = rows(term_index.search(built, asked, 4, scope=scope))
    whole = search.bm25_search(docs.where("kb_id IS NOT NULL"), asked, 10**6).collect()
    assert {r[0] for r in got} == {1, 3} and {r[2] for r in got if r[0] == 3} == {"b"}
    best = sorted((r for r in whole if r["query_id"] == 1 and r["kb_id"] in "ab"), key=lambda r: r["rank"])[:4]
    assert [r[1] for r in sorted(got, key=lambda r: r[4]) if r[0] == 1] == [r["doc_id"] for r in best]
    assert term_index.search(built, asked, 4, scope=scope.where("false")).count() == 0
    only = spark.createDataFrame([(1, "y"), (2, "none")], "query_id long, domain string")
    kind = {r[1]: r[3] for r in made_docs()}
    narrowed = term_index.search(built, asked, 4, filters=only).collect()
    ids = {q: [r["doc_id"] for r in sorted(narrowed, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert ids[1] == [r["doc_id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query_id"] == 1 and kind[r["doc_id"]] == "y"][:4]
    assert ids[2] == [] and ids[3] == [r["doc_id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query_id"] == 3][:4]


def test_scope_prunes_folders_at_run_time(spark, built, asked):
    scope = spark.createDataFrame([(1, "b")], "query_id long, kb_id string")
    plan = built.rows("postings", term_index.BLOCKS, built.manifest(scope))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "kb_id" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_changes_equal_a_fresh_build_and_touch_their_slices(spark, docs, asked):
    t = term_index.build(docs, shared_folder(spark, "terms"), attributes=("domain",), slice_docs=20, range_docs=4)
    before = {(r["kb_id"], r["slice"]): r["batch"] for r in t.manifest().collect()}
    more = spark.createDataFrame([("a", 3, "w00 w05 w05", "x", 1), ("a", 3, "w39 w39", "y", 2), ("b", 9999, "w30 w31", "x", 1), ("e", 5, "w00", "x", 1)], "kb_id string, doc_id long, text string, domain string, at int")
    gone = spark.createDataFrame([("b", 1004), ("a", 77), ("a", 123456), ("zz", 1)], "kb_id string, doc_id long")
    term_index.change(t, more, gone, attributes="domain string", order="at", slice_docs=20, range_docs=4)
    after = {(r["kb_id"], r["slice"]): r["batch"] for r in t.manifest().collect()}
    same = [s for s in before if after.get(s) == before[s]]
    assert 0 < len(before) - len(same) <= 5 and ("e", 0) in after
    final = docs.join(gone, ["kb_id", "doc_id"], "left_anti").where("NOT (kb_id = 'a' AND doc_id = 3)").select("kb_id", "doc_id", "text", "domain").unionByName(more.where("at = 2 OR doc_id <> 3").drop("at"))
    assert rows(term_index.search(t, asked, 6)) == plain(final, asked, 6)
    fresh = term_index.build(final, shared_folder(spark, "terms"), slice_docs=20)
    key = lambda x: rows(x.beside("frequencies", term_index.FREQUENCIES).select("kb_id", "df", "n_terms"))
    assert key(t) == key(fresh)
    old = type(t)(t.spark, t.path, 0)  # the version before is still there
    assert rows(term_index.search(old, asked, 6)) == plain(docs, asked, 6)
    term_index.drop_kb(t, spark.createDataFrame([("a",)], "kb_id string"))
    assert rows(term_index.search(t, asked, 6)) == plain(final.where("kb_id <> 'a'"), asked, 6)


def test_empty_indexes(spark, docs, asked):
    t = term_index.build(docs.where("false"), shared_folder(spark, "terms"), attributes=("domain",))
    assert term_index.search(t, asked, 3).count() == 0
    term_index.change(t, docs, attributes="domain string")
    assert rows(term_index.search(t, asked, 3)) == plain(docs, asked, 3)
    v = vector_index.build(spark.createDataFrame([], "kb_id string, vec_id long, embedding array<float>"), shared_folder(spark, "vectors"))
    assert vector_index.search(v, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>"), 3).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(2)
    means = draw.standard_normal((6, 24)) * 2
    out = [(("a", "a", "b")[i % 3], i, (means[i % 6] + draw.standard_normal(24)).astype(np.float32).tolist(), "xy"[i % 2]) for i in range(700)]
    out += [("a", 800 + i, out[0][2], "x") for i in range(300)]  # a hot group of copies
    bad = [("a", 2000, None, "x"), ("a", 2001, [0.0] * 24, "x"), ("b", 2002, [float("nan")] * 24, "y"), (None, 2003, [1.0] * 24, "y")]
    return spark.createDataFrame(out + bad, "kb_id string, vec_id long, embedding array<float>, domain string")


@pytest.fixture(scope="module")
def stored(spark, vectors):
    return vector_index.build(vectors, shared_folder(spark, "vectors"), label="domain", cells=8, slice_docs=150)


def good(vectors):
    return vectors.where("vec_id < 2000")


def test_vector_index_exact(stored, vectors):
    q = good(vectors).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = rows(search.dense_search(good(vectors).select("vec_id", "embedding"), q.withColumnRenamed("vector", "embedding"), 7))
    for first in (1, 3):
        got = vector_index.search(stored, q, 7, others=True, first=first)
        assert rows(got.select("query_id", "vec_id", "score", "rank")) == want


def test_vector_index_probes_scope_filters(spark, stored, vectors):
    q = good(vectors).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r["query_id"], r["vec_id"]) for r in vector_index.search(stored, q, 7).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vector_index.search(stored, q, 7, probes=3).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    scope = spark.createDataFrame([(50, "b"), (100, "a")], "query_id long, kb_id string")
    only = spark.createDataFrame([(50, "x")], "query_id long, domain string")
    got = vector_index.search(stored, q, 9, scope=scope, filters=only).collect()
    place = {r["vec_id"]: (r["kb_id"], r["domain"]) for r in vectors.collect()}
    assert {r["query_id"] for r in got} == {50, 100} and len(got) == 18
    assert all(place[r["vec_id"]] == ("b", "x") for r in got if r["query_id"] == 50) and all(place[r["vec_id"]][0] == "a" for r in got if r["query_id"] == 100)
    within = good(vectors).where("kb_id = 'b' AND domain = 'x'").select("vec_id", "embedding")
    want = search.dense_search(within, q.where("query_id = 50").withColumnRenamed("vector", "embedding"), 9)
    mine = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 50 and r["vec_id"] != 50]
    assert sorted(mine)[:8] and set(mine) <= {(r["vec_id"], r["score"]) for r in want.collect()}


def test_vector_changes(spark, vectors):
    t = vector_index.build(vectors, shared_folder(spark, "vectors"), label="domain", cells=8, slice_docs=150)
    before = {(r["kb_id"], r["slice"]): r["batch"] for r in t.manifest().collect()}
    more = spark.createDataFrame([("b", 5, [float(i == 3) for i in range(24)], "x"), ("b", 3000, [float(i == 3) + 0.1 for i in range(24)], "y"), ("b", 2, None, "x")], "kb_id string, vec_id long, embedding array<float>, domain string")
    gone = spark.createDataFrame([("a", 0), ("zz", 1)], "kb_id string, vec_id long")
    vector_index.change(t, more, gone, label="domain")
    after = {(r["kb_id"], r["slice"]): r["batch"] for r in t.manifest().collect()}
    assert 0 < sum(after.get(s) != b for s, b in before.items()) <= 4
    q = spark.createDataFrame([(1, [float(i == 3) for i in range(24)])], "query_id long, vector array<float>")
    got = [(r["vec_id"], r["score"]) for r in vector_index.search(t, q, 2).collect()]
    final = good(vectors).where("vec_id NOT IN (0, 5, 2)").select("vec_id", "embedding").unionByName(more.where("embedding IS NOT NULL").select("vec_id", "embedding"))
    want = [(r["vec_id"], r["score"]) for r in search.dense_search(final, q.withColumnRenamed("vector", "embedding"), 2).orderBy("rank").collect()]
    assert sorted(got) == sorted(want) and got[0][0] in (5, 3000)
    assert sum(r["n_docs"] for r in t.manifest().collect()) == 1000 - 1 - 1 + 1


def test_containing_brute_force(spark):
    docs = [(1, "abc def"), (2, "bc"), (3, None), (4, ""), (5, "中文的文本"), (6, "aaaa"), (7, "abc defabc def")]
    items = [(1, "bc"), (2, "a"), (3, "中文"), (4, ""), (5, None), (6, "bc d"), (7, "bc"), (8, "aa")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, query string")
    want = sorted((i, k) for i, p in items if p for k, t in docs if t and p in t)
    assert sorted(map(tuple, evaluate.containing(d, q).collect())) == want
    assert evaluate.containing(d, q.where("false")).count() == 0


def test_retrieval_of_odd_requests(spark, docs, built):
    from corpuslens.functions.vectors import hashed

    v = vector_index.build(hashed(docs, "doc_id", keep=("kb_id", "domain")), shared_folder(spark, "vectors"), "doc_id", "vector", "domain", cells=4)
    r = spark.createDataFrame([(1, "w00 w01", 3, None), (2, "", 5, None), (3, None, None, 0.5), (4, "w39 w38", 0, None), (5, "w05", None, None)], "query_id long, query string, top_k int, threshold double")
    parts = spark.createDataFrame([(1, 1, "w30 w31"), (1, 2, "w30")], "query_id long, n int, sub_query string")
    got = retrieve.retrieved(built, v, r, parts).collect()
    assert {x["query_id"] for x in got} == {1, 5}
    mine = [x for x in got if x["query_id"] == 1]
    assert sum(x["part"] == 0 for x in mine) == 3 and any(x["part"] > 0 for x in mine) and len({x["doc_id"] for x in mine}) == len(mine)
    assert [x["fusion_score"] for x in sorted(mine, key=lambda x: x["rank"])] == sorted((x["fusion_score"] for x in mine), reverse=True)
    scope = spark.createDataFrame([(5, "b")], "query_id long, kb_id string")
    assert {(x["query_id"], x["kb_id"]) for x in retrieve.retrieved(built, v, r, parts, scope=scope).collect()} == {(5, "b")}
    assert retrieve.retrieved(built, v, r.where("false")).count() == 0
    docs4 = docs.select("doc_id", "text", F.lit("valid").alias("governance_status"), F.lit("t").alias("title"))
    page = retrieve.searched(built, v, r.select("query_id", "query"), docs4, 2).collect()
    assert {x["query_id"] for x in page} == {1, 4, 5} and all(x["rank"] <= 2 for x in page)


def test_token_lists_equal_the_column(spark):
    from corpuslens.functions import text as T

    odd = ["a-B c--d -e f- The THE", "x1.2.3y 4. .5 6.7", "混凝土C30强度的 a　b c\x1cd\x85e", "Kelvin İx ß ١٢", "l" * 100 + "-" + "M" * 70, "", None, "的 一 q 7"]
    for text, want in spark.createDataFrame([(t,) for t in odd], "t string").select("t", T.tokenize(F.col("t"))).collect():
        assert T.token_list(text) == want
        assert T.token_counts(text) == {w: want.count(w) for w in want}


def test_search_hands_on_best_scores_only(spark):
    """What leaves the scoring is bounded by tasks, queries and k, however many documents hold the terms."""
    given = [("a" if i % 3 else "b", i, f"w00 w{i % 7:02d} w{i % 11 + 10:02d}", "x") for i in range(6000)]
    d = spark.createDataFrame(given, "kb_id string, doc_id long, text string, domain string")
    q = spark.createDataFrame([(1, "w00 w03"), (2, "w12 w05 w00")], "query_id long, query string")
    t = term_index.build(d, shared_folder(spark, "terms"), attributes=("domain",), range_docs=50)
    written, made = term_index.written, []
    term_index.written = lambda df, name: (made.append((name, out := written(df, name))), out)[1]
    try:
        got = term_index.search(t, q, 5)
    finally:
        term_index.written = written
    scored = dict(made)["scored"]
    assert scored.count() <= 5 * 2 * 8 and rows(got) == plain(d, q, 5) and got.count() == 10


def test_queries_sent_equal_queries_as_rows(stored, vectors, monkeypatch):
    q = good(vectors).where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vector_index.search(stored, q, 5, others=True, least=0.1)
    sent = rows(got)
    monkeypatch.setattr(vector_index, "SENT_QUERIES", 3)
    assert sent == rows(vector_index.search(stored, q, 5, others=True, least=0.1)) and sent


def test_texts_of_candidates_are_picked_where_they_are_read(spark):
    """No text but those of candidates is shuffled: 2,000 long texts, of which 2 are wanted."""
    from corpuslens.operators import retrieve
    from corpuslens.sources.sliced import fetched

    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 50) AS text", "'valid' AS governance_status")
    rows = spark.createDataFrame([("a", 7), ("b", 9), ("b", 7), ("b", 5000)], "query_id string, doc_id long")
    assert sorted(r["doc_id"] for r in fetched(docs, rows, "doc_id", "texts").collect()) == [7, 9]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = retrieve.with_texts(rows, spark.createDataFrame([("a", "word7"), ("b", "word9")], "query_id string, query string"), docs)
        plan = texts._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["query_id"], r["doc_id"]): (r["content"][:5], round(r["cosine"], 6)) for r in texts.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Range" not in plan  # the documents themselves are not joined
    assert set(got) == {("a", 7), ("b", 9), ("b", 7), ("b", 5000)} and got["b", 5000] == ("", 0.0) and got["a", 7][1] > 0.5


def test_sketches_are_shuffled_once(spark, monkeypatch):
    from corpuslens.operators import neighbours

    plans, allowed = [], neighbours._allowed
    monkeypatch.setattr(neighbours, "_allowed", lambda placed, most: plans.append(placed._jdf.queryExecution().optimizedPlan().toString()) or allowed(placed, most))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    assert neighbours.nearest_similar(v).count() == 60
    assert plans[0].count("Aggregate") <= 1 and "Join LeftOuter" in plans[0]  # large buckets alone are looked up


def test_tokens_of_odd_texts_are_those_of_the_column(spark):
    from pyspark.sql import functions as F

    from corpuslens.functions import text as T

    odd = [None, "", " ", "The a-B c- GB50010-2010 1.2.3. ٣ İstanbul \u212a x\u00a0y 钢筋ABC的 的 A b\x00c ΑΣ"]
    made = [r["t"] for r in spark.createDataFrame([(x,) for x in odd], "x string").select(T.tokenize(F.col("x")).alias("t")).collect()]
    assert [T.token_list(x) for x in odd] == made


def test_disk_of_a_crowd_grows_with_its_rows(spark, monkeypatch):
    """A crowd of 300 near copies: no table holds pairs of them, and only so many copies of their sketches are moved at once."""
    import numpy as np

    from corpuslens.operators import neighbours, vector_index

    rows, copies, allowed, written = {}, [], neighbours._allowed, neighbours.written

    def counted(df, name):
        out = written(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neighbours, "CROWD", 8)
    monkeypatch.setattr(vector_index, "SENT_QUERIES", 0)
    monkeypatch.setattr(neighbours, "_allowed", lambda placed, most: copies.append(placed.count()) or allowed(placed, most))
    for module in (neighbours, vector_index):
        monkeypatch.setattr(module, "written", counted)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(32) + 0.1 * rng.standard_normal((300, 32))).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = {tuple(r) for r in neighbours.nearest_similar(v).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert found == {(i, int(s[i].argmax()), float(s[i].max())) for i in range(300)}
    assert max(rows.values()) <= 10 * 300 and max(copies) <= 8 * 300


def test_misses_are_attributed_from_two_searches(spark, small):
    """The narrow list is searched, not picked out of the broad one, and rules that need reranking and means of both channels fire."""
    from corpuslens.plans.registry import QUERIES

    rows = QUERIES["miss_attribution"](spark, small).collect()
    assert {(r["n_intent"], r["n_broad"]) for r in rows} == {(10, 10)}
    assert {"missing_doc", "rewrite_drift", "intent_misroute"} <= {r["verdict"] for r in rows}
