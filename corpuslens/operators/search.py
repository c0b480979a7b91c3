"""Retrieval for whole tables of queries: BM25, vectors, fusion, reranking, relevance floor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import hash_vectors

K1, B, EPSILON = 1.5, 0.75, 0.25


def top(df: DataFrame, by: str, score: str, tie: str, k: int | Column) -> DataFrame:
    """The k best rows of each `by` with their rank; ties go to the smaller `tie`."""
    at = W.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str = "doc_id", kb: str = "kb_id", text: str = "text") -> DataFrame:
    """(kb, key, term, tf, dl)."""
    t = docs.select(kb, key, T.tokenize(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return t.select(kb, key, "dl", F.explode("t").alias("term")).groupBy(kb, key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", kb: str = "kb_id", allowed: Column | None = None) -> DataFrame:
    """(query_id, key, kb, score, rank). Statistics are of the whole kb; `allowed` filters documents after scoring.

    A rare term's weight is ln((N-n+.5)/(n+.5)); a negative one becomes EPSILON times the mean weight of the kb's terms.
    Where the best score of a kb is not above 0, the share of the query's tokens counts.
    """
    sizes = docs.select(kb, F.size(T.tokenize(F.col("text"))).alias("dl")).groupBy(kb).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    post = postings(docs, key, kb)
    df = post.groupBy(kb, "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), kb)  # a row for each kb
    idf = df.select(kb, "term", "avgdl", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = idf.groupBy(kb).agg(F.avg("idf").alias("mean_idf"))
    q = queries.select("query_id", T.tokenize(F.col("query")).alias("t"))
    q = q.select("query_id", F.size(F.array_distinct("t")).alias("n_q"), F.explode("t").alias("term")).groupBy("query_id", "n_q", "term").agg(F.count("*").alias("qtf"))
    terms = idf.join(q.select("term").distinct(), "term", "left_semi").join(F.broadcast(mean), kb)
    weight = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    terms = terms.select(kb, "term", "avgdl", weight.alias("idf"))
    hits = post.join(terms, [kb, "term"]).join(q, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = hits.groupBy("query_id", "n_q", kb, key).agg(F.sum(part).alias("s"), F.count("*").alias("overlap"))
    s = s.withColumn("s", F.round(F.col("s") + 0.01 * F.col("overlap"), 6))
    best = s.groupBy("query_id", kb).agg(F.max("s").alias("best"))
    s = s.join(best, ["query_id", kb]).withColumn("s", F.when(F.col("best") <= 0, F.col("overlap") / F.col("n_q")).otherwise(F.col("s"))).where("s > 0")
    if allowed is not None:
        s = s.join(docs.where(allowed).select(key), key, "left_semi")
    s = top(s, "query_id", "s", key, k)
    return s.withColumn("score", F.round(F.col("s") / F.max("s").over(W.partitionBy("query_id")), 6)).select("query_id", key, kb, "score", "rank")


def hash_vector_search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank) by cosine of hashed text vectors: sparse dot products by a join on buckets."""
    d, q = hash_vectors(docs, key), hash_vectors(queries, "query_id", "query")
    s = d.join(q.withColumnRenamed("value", "qv"), "bucket")
    s = s.groupBy("query_id", key).agg(F.round(F.sum(F.col("value") * F.col("qv")), 6).alias("score"))
    return top(s, "query_id", "score", key, k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 4096, rows: int = 2048) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors, by cosine, of each query (query_id, and the same columns), itself excepted.

    Queries are taken in blocks of `block`; each is sent to all tasks, which keep the k best of each query and hand on no
    more, so nothing but those is shuffled. Keys are longs. A vector of length 0 is like none; null vectors are left out. Ties
    go to the smaller key.
    """
    spark, out = vectors.sparkSession, None
    given = vectors.where(F.col(column).isNotNull()).select(key, column)
    held, parts = queries.where(F.col(column).isNotNull()).select("query_id", column), []
    for r in held.toLocalIterator():  # one block of the stated query set at a time
        parts.append(r)
        if len(parts) == block:
            out, parts = _nearest(given, parts, k, key, column, rows, spark, out), []
    if parts or out is None:
        out = _nearest(given, parts, k, key, column, rows, spark, out)
    return top(out, "query_id", "score", key, k).select("query_id", key, "score", "rank")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def _nearest(vectors: DataFrame, block: list, k: int, key: str, column: str, rows: int, spark, before: DataFrame | None) -> DataFrame:
    ids = np.array([r["query_id"] for r in block], dtype=np.int64)
    sent = spark.sparkContext.broadcast((ids, _unit(np.array([r[column] for r in block], dtype=np.float64)) if len(block) else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        best = pd.DataFrame({"query_id": ids[:0], key: ids[:0], "score": np.zeros(0)})
        for b in batches if q is not None else ():
            for at in range(0, len(b), rows):
                x = b.iloc[at : at + rows]
                own = x[key].to_numpy(dtype=np.int64)
                s = np.round(q @ _unit(np.stack(x[column].to_list()).astype(np.float64)).T, 6)
                s[ids[:, None] == own[None, :]] = -2.0
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -1.5)
                i, j = np.nonzero((s >= least[:, None]) & (s > -1.5))
                best = pd.concat([best, pd.DataFrame({"query_id": ids[i], key: own[j], "score": s[i, j]})], ignore_index=True)
                best = best.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        yield best

    found = vectors.mapInPandas(run, f"query_id long, `{key}` long, score double")
    return found if before is None else before.unionByName(found)


def fuse(vector: DataFrame, bm25: DataFrame, key: str = "doc_id", wv: float | Column = 0.6, wb: float | Column = 0.4, rrf_k: int = 60, threshold: float | Column = 0.15, k: int | Column = 20, prior: Column | DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank and weighted score fusion of two ranked lists, with a bonus where both have a row. `prior` multiplies
    the score: a column, or a table (key, prior) of which candidates take their row, 1 without."""
    wv, wb = (F.lit(x) if isinstance(x, float) else x for x in (wv, wb))
    v = vector.select("query_id", key, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = bm25.select("query_id", key, F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    c = v.join(b, ["query_id", key], "full_outer")
    if isinstance(prior, DataFrame):
        c, prior = c.join(prior, key, "left"), F.coalesce("prior", F.lit(1.0))
    rrf = F.coalesce(wv / (rrf_k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(wb / (rrf_k + F.col("bm25_rank")), F.lit(0.0))
    weighted = wv * F.coalesce("vector_score", F.lit(0.0)) + wb * F.coalesce("bm25_score", F.lit(0.0))
    both = F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull(), 1.12).otherwise(1.0)
    score = (0.5 * rrf * rrf_k + 0.5 * weighted) * both * (F.lit(1.0) if prior is None else prior)
    c = c.withColumn("fusion_score", F.round(score, 6)).where(F.col("fusion_score") >= threshold)
    return top(c, "query_id", "fusion_score", key, k).drop("prior")


def domain_prior(domain: Column, order: Column) -> Column:
    """What `fuse` takes as prior: 1 + 0.06 for each domain of the query's order from the candidate's on; 1 for others."""
    at = F.coalesce(F.array_position(order, domain), F.lit(0))
    return F.when(at > 0, 1.0 + 0.06 * (F.size(order) - at + 1)).otherwise(1.0)


def lexical_score(query: Column, doc: Column, mandatory: tuple[str, ...] = T.MANDATORY[:3]) -> Column:
    """Token cover, phrase, dotted-number and mandatory-word signals."""
    q = F.array_distinct(T.tokenize(query))
    cover = F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokenize(doc))) / F.size(q)).otherwise(0.0)
    return 0.55 * cover + 0.20 * T.phrase_hit(query, doc) + T.number_hit(query, doc) + F.when(doc.rlike("|".join(mandatory)), 0.1).otherwise(0.0)


def rerank(candidates: DataFrame, keep: int = 6, decay: bool = False) -> DataFrame:
    """Adds rerank_score and final_score to candidates (query_id, query, doc_id, content, rank, fusion_score, cosine, is_mandatory, governance_status); keeps the best."""
    lexical = lexical_score(F.col("query"), F.col("content"))
    if decay:  # here the word counts as mandatory at the head of a text, too
        head = F.substring("content", 1, 80).contains("应") & ~F.col("content").rlike("|".join(T.MANDATORY[:3]))
        lexical = lexical + F.when(head, 0.1).otherwise(0.0)
    score = lexical / (1 + 0.05 * (F.col("rank") - 1)) if decay else 0.65 * F.greatest(F.col("cosine"), F.lit(0.0)) + 0.35 * lexical
    boost = F.when(F.col("is_mandatory"), 1.10).otherwise(1.0) * F.when(F.col("governance_status") == "deprecated", 0.55).when(F.col("governance_status") == "need_update", 0.85).otherwise(1.0)
    c = candidates.withColumn("rerank_score", F.round(F.least(score, F.lit(1.0)), 6)).drop("rank")
    c = top(c, "query_id", "rerank_score", "doc_id", keep * 3).drop("rank")
    c = c.withColumn("final_score", F.round((0.65 * F.col("rerank_score") + 0.35 * F.least("fusion_score", F.lit(1.0))) * boost, 6))
    return top(c, "query_id", "final_score", "doc_id", keep)


def relevance_floor(ranked: DataFrame, floor: float = 0.45, ratio: float = 0.75, support: int = 2) -> DataFrame:
    """Adds `rejected`: the best score is under the floor, or too few rows come near it."""
    at = W.partitionBy("query_id")
    ok = (F.max("final_score").over(at) >= floor) & (F.count_if(F.col("final_score") >= floor * ratio).over(at) >= support)
    return ranked.withColumn("rejected", ~ok)
