"""The retrieval stages over stored indexes: each query by its own plan, its parts and its scopes in one scoring pass.

A request is a row (query_id, query, top_k, threshold, vector_weight, bm25_weight, domains): its limits are columns. What is asked
for one query besides, such as the parts of a question that asks several things, or the same question in a narrower scope, are
rows of the same table told apart by a tag, so that both indexes are read once for all of them. Nulls in a limit take the
engine's default; requests without words and vectors find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import cosine, hashed
from corpuslens.operators import answers, term_index, vector_index
from corpuslens.operators.search import domain_prior, lexical_score, relevance_floor, rerank, top
from corpuslens.sources.sliced import Sliced, fetched, written

LIMITS = {"top_k": 20, "threshold": 0.15, "vector_weight": 0.6, "bm25_weight": 0.4}
RRF_K, BOTH, BM25_DEPTH = 60, 1.12, 2


def _limited(requests: DataFrame) -> DataFrame:
    """Requests with all limits."""
    own = set(requests.columns)
    out = requests.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in own else F.lit(v) for c, v in LIMITS.items()})
    none = F.array().cast("array<string>")
    return out.withColumn("domains", F.coalesce("domains", none) if "domains" in own else none)


def fused(terms: Sliced, vectors: Sliced, requests: DataFrame, key: str = "doc_id", scope: DataFrame | None = None, filters: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, key, kb_id, vector_score, vector_rank, bm25_score, bm25_rank, fusion_score, rank) of requests (query_id, query,
    limits). `domains` puts a prior on candidates of those domains, in their order; `scope` (query_id, kb_id) and `filters`
    (query_id, domain) leave out others in both channels. `probes` is that of `vector_index.search`."""
    r = _limited(requests).where("top_k > 0")
    asked = r.select("query_id", "query", F.col("top_k").alias("k"), (F.col("top_k") * BM25_DEPTH).alias("deep"))
    b = term_index.search(terms, asked, "deep", key, scope, filters)
    v = vector_index.search(vectors, hashed(asked, "query_id", "query", keep=("k",)), "k", key, probes=probes, scope=scope, filters=filters)
    each = lambda df, name: df.select("query_id", key, "kb_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    c = each(v, "vector").join(each(b, "bm25"), ["query_id", key, "kb_id"], "full_outer").join(r.drop("query"), "query_id")
    none = F.lit(0.0)
    near = F.coalesce(F.col("vector_weight") / (RRF_K + F.col("vector_rank")), none) + F.coalesce(F.col("bm25_weight") / (RRF_K + F.col("bm25_rank")), none)
    weighted = F.col("vector_weight") * F.coalesce("vector_score", none) + F.col("bm25_weight") * F.coalesce("bm25_score", none)
    both = F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull(), BOTH).otherwise(1.0)
    known = term_index.stored_documents(terms, "domain string").select("kb_id", F.col("key").alias(key), "domain")
    c = c.join(known, ["kb_id", key], "left").withColumn("fusion_score", F.round((0.5 * near * RRF_K + 0.5 * weighted) * both * domain_prior(F.col("domain"), F.col("domains")), 6))
    c = top(c.where(F.col("fusion_score") >= F.col("threshold")), "query_id", "fusion_score", key, F.col("top_k"))
    return c.select("query_id", key, "kb_id", "domain", "vector_score", "vector_rank", "bm25_score", "bm25_rank", "fusion_score", "rank")


def _tagged(tag: Column) -> Column:
    return F.concat_ws("#", F.col("query_id").cast("string"), tag.cast("string"))


def retrieved(terms: Sliced, vectors: Sliced, requests: DataFrame, parts: DataFrame | None = None, codes: DataFrame | None = None, key: str = "doc_id", scope: DataFrame | None = None, filters: DataFrame | None = None, weight: float = 0.9) -> DataFrame:
    """Candidates of requests, as `fused` gives them, with `part`: those of the question itself have 0, then come those that only its
    `parts` (query_id, n, sub_query) found, a third as many each and at the engine's weights, with a lower score. `codes`
    (query_id, codes) and the documents' codes (key, standard_code), as a pair, raise candidates whose code begins like one asked for."""
    r = _limited(requests)
    main = r.withColumn("part", F.lit(0))
    if parts is not None:
        own = r.join(parts.select("query_id", F.col("n").cast("int").alias("part"), "sub_query"), "query_id").drop("query").withColumnRenamed("sub_query", "query")
        own = own.withColumns({"top_k": F.greatest(F.lit(4), F.floor(F.col("top_k") / 3).cast("int")), **{c: F.lit(v) for c, v in LIMITS.items() if c != "top_k"}})
        main = main.unionByName(own.select(*main.columns))
    named = main.withColumn("rid", _tagged(F.col("part")))
    back = named.select(F.col("rid").alias("query_id"), F.col("query_id").alias("own"), "part")
    told = lambda df: df if df is None else df.join(named.select("query_id", "rid"), "query_id").drop("query_id").withColumnRenamed("rid", "query_id")
    c = fused(terms, vectors, named.drop("query_id", "part").withColumnRenamed("rid", "query_id"), key, told(scope), told(filters)).join(back, "query_id")
    c = c.drop("query_id", "rank").withColumnRenamed("own", "query_id")
    seen = c.groupBy("query_id", key).agg(F.min("part").alias("part"))
    c = c.join(seen, ["query_id", key, "part"], "left_semi").withColumn("fusion_score", F.when(F.col("part") > 0, F.round(F.col("fusion_score") * weight, 6)).otherwise(F.col("fusion_score")))
    if codes is not None:
        asked, known = codes
        c = answers.boost_codes(c.join(known.select(key, "standard_code"), key, "left"), asked).drop("standard_code", "rank")
    return top(c, "query_id", "fusion_score", key, 1 << 30)


def with_texts(candidates: DataFrame, queries: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with query, content, the documents' other columns, whether they are mandatory, and the cosine of both texts. A
    document that is gone leaves an empty text. Candidates are few for each query, so their documents alone are fetched, once."""
    candidates = written(candidates, "candidates")
    docs = fetched(docs, candidates, key, "candidate-texts")
    c = candidates.join(queries.select("query_id", "query"), "query_id").join(docs.withColumnRenamed("text", "content").drop("kb_id", "domain"), key, "left")
    c = c.withColumn("content", T.text_or_empty(F.col("content"))).withColumn("is_mandatory", T.is_mandatory(F.col("content")))
    dv = hashed(docs.select(key, "text"), key).withColumnRenamed("vector", "_d")
    qv = hashed(queries.select("query_id", "query"), "query_id", "query").withColumnRenamed("vector", "_q")
    pair = candidates.select("query_id", key).join(dv, key).join(qv, "query_id").select("query_id", key, cosine(F.col("_q"), F.col("_d")).alias("cosine"))
    return c.join(pair, ["query_id", key], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def searched(terms: Sliced, vectors: Sliced, queries: DataFrame, docs: DataFrame, k: int = 10, reranked: bool = True, key: str = "doc_id", scope: DataFrame | None = None, filters: DataFrame | None = None, cut: int = 500) -> DataFrame:
    """What a search page shows: the k best of a pool of max(3k, 20) at default weights, reranked, with all scores, title, code,
    content cut for display and the terms that query and document share."""
    pool = fused(terms, vectors, queries.select("query_id", "query", F.lit(max(3 * k, LIMITS["top_k"])).alias("top_k")), key, scope, filters)
    c = with_texts(pool, queries, docs, key)
    score = F.least(0.65 * F.greatest(F.col("cosine"), F.lit(0.0)) + 0.35 * lexical_score(F.col("query"), F.col("content")), F.lit(1.0))
    c = c.withColumn("rerank_score", F.round(score, 6) if reranked else F.lit(0.0)).drop("rank")
    if reranked:
        c = top(c, "query_id", "rerank_score", key, k).drop("rank").withColumn("final_score", F.round(F.round(0.65 * F.col("rerank_score") + 0.35 * F.least("fusion_score", F.lit(1.0)), 9), 6))
    else:
        c = c.withColumn("final_score", F.col("fusion_score"))
    shared = F.array_sort(F.array_intersect(F.array_distinct(T.tokenize(F.col("query"))), T.tokenize(F.col("content"))))
    shown = [T.text_or_empty(F.col(x)).alias(x) for x in ("title", "standard_code") if x in docs.columns]
    zero = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("vector_score", "bm25_score")]
    return top(c, "query_id", "final_score", key, k).select("query_id", key, "rank", "domain", *shown, T.truncate_to(F.col("content"), cut).alias("content"), "is_mandatory", *zero, "fusion_score", "rerank_score", "final_score", shared.alias("matched_terms"))


def delivered(candidates: DataFrame, keep: int = 6, floor: float = 0.45) -> DataFrame:
    """Candidates with texts after reranking and the relevance floor: the `keep` best with rerank_score, final_score, rank and `rejected`."""
    return relevance_floor(rerank(candidates, keep), floor)


def explained_rows(candidates: DataFrame, ranked: DataFrame, key: str = "doc_id", floor: float = 0.45, ratio: float = 0.75, support: int = 2, cut: int = 160) -> tuple[DataFrame, DataFrame]:
    """Why a query was answered as it was. Rows of what was delivered or, where the floor rejected it, of what it rejected: scores
    and ranks of each channel, shared terms, snippet, `used` and which channels found it. And one row for each query of
    `candidates`: how many there were, how many were delivered, how many each channel found, and the reason of a rejection."""
    found = lambda c: F.col(c).isNotNull()
    signal = F.when(found("vector_rank") & found("bm25_rank"), "both").when(found("vector_rank"), "vector").when(found("bm25_rank"), "bm25").otherwise("none")
    shared = F.array_sort(F.array_intersect(F.array_distinct(T.tokenize(F.col("query"))), T.tokenize(F.col("content"))))
    rows = ranked.select(
        "query_id", key, "rank", "domain", T.truncate_to(F.col("content"), cut).alias("snippet"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "vector_rank", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "bm25_rank",
        "fusion_score", "rerank_score", "final_score", shared.alias("matched_terms"), F.size(shared).alias("match_count"), "is_mandatory", "governance_status", (~F.col("rejected")).alias("used"), signal.alias("signal"),
    )
    n = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    s = ranked.groupBy("query_id").agg(
        F.count_if(~F.col("rejected")).alias("final_count"), F.count_if(found("vector_rank")).alias("n_vector"), F.count_if(found("bm25_rank")).alias("n_bm25"), F.count_if(found("vector_rank") & found("bm25_rank")).alias("n_both"),
        F.max("final_score").alias("top_score"), F.count_if(F.col("final_score") >= floor * ratio).alias("support"), F.bool_or("rejected").alias("below_floor"),
    )
    why = F.format_string(f"best %.3f, %d near it: at least {floor} and {support} of {floor * ratio:.4f} are asked for", F.col("top_score"), F.col("support"))
    return rows, n.join(s, "query_id", "left").withColumn("rejection_reason", F.when(F.col("below_floor"), why))


def miss_inputs(terms: Sliced, vectors: Sliced, queries: DataFrame, docs: DataFrame, k: int = 10, key: str = "doc_id", parent: str = "doc_id", scope: DataFrame | None = None) -> DataFrame:
    """What `answers.attributed` asks for: queries (query_id, query, domains, intent_confidence) within the intent's domains and
    anywhere, two tags of one pass. `parent` names the document that a row of `docs` is a piece of: `most_of_one` counts the
    pieces of one document in the narrower list. A query without domains is not narrowed."""
    r = queries.select("query_id", "query", F.lit(k).alias("top_k"))
    both = r.select("*", F.explode(F.array(F.lit("intent"), F.lit("broad"))).alias("tag")).withColumn("rid", _tagged(F.col("tag")))
    named = lambda df: df.join(both.select("query_id", "rid"), "query_id").drop("query_id").withColumnRenamed("rid", "query_id")
    narrow = queries.select(F.concat_ws("#", F.col("query_id").cast("string"), F.lit("intent")).alias("query_id"), F.explode("domains").alias("domain"))
    c = fused(terms, vectors, both.drop("query_id", "tag").withColumnRenamed("rid", "query_id"), key, None if scope is None else named(scope), narrow)
    c = written(c.join(both.select(F.col("rid").alias("query_id"), F.col("query_id").alias("own"), "tag"), "query_id").drop("query_id").withColumnRenamed("own", "query_id"), "tagged-candidates")
    own = c.where("tag = 'intent'")
    texts = with_texts(own.select("query_id", key), queries, docs.select(key, "text"), key)
    score = F.least(0.65 * F.greatest(F.col("cosine"), F.lit(0.0)) + 0.35 * lexical_score(F.col("query"), F.col("content")), F.lit(1.0))
    best = texts.groupBy("query_id").agg(F.max(F.round(score, 6)).alias("top_rerank"))
    most = own.select("query_id", key).join(fetched(docs.select(key, F.col(parent).alias("_of")), own, key, "candidate-parents"), key).groupBy("query_id", "_of").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max("n").alias("most_of_one"))
    mine = F.col("tag") == "intent"
    mean = lambda x: F.round(F.avg(F.when(mine, F.coalesce(x, F.lit(0.0)))), 9)
    m = c.groupBy("query_id").agg(
        F.count_if(mine).alias("n_intent"), F.count_if(~mine).alias("n_broad"), F.max(F.when(mine, F.col("fusion_score"))).alias("top_fusion"), F.max(F.when(~mine, F.col("fusion_score"))).alias("top_broad"),
        mean("bm25_score").alias("mean_bm25"), mean("vector_score").alias("mean_vector"),
    )
    out = queries.select("query_id", "intent_confidence").join(m, "query_id", "left").join(best, "query_id", "left").join(most, "query_id", "left")
    return out.fillna(0, ["n_intent", "n_broad", "top_fusion", "top_broad", "mean_bm25", "mean_vector", "top_rerank", "most_of_one"])
