"""Ranked lists against golden sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the texts that one pass over the documents looks for.
BLOCK_BYTES = 32 << 20


def ranking_metrics(ranked: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "doc_id", discount: str = "reciprocal") -> DataFrame:
    """(query_id, n_relevant, mrr, recall_k, ndcg_k ...) of every query in `golden`; a hit at rank r counts 1/(r+1), or 1/log2(r+1)."""
    rel = golden.groupBy("query_id").agg(F.countDistinct(key).alias("n_relevant"))
    hit = ranked.join(golden.select("query_id", key).distinct(), ["query_id", key]).select("query_id", "rank")
    worth = lambda r: 1.0 / (r + 1) if discount == "reciprocal" else 1.0 / F.log2(r + 1)
    aggs = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, worth(F.col("rank")))).alias(f"dcg_{k}")]
    m = rel.join(hit.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = [F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + worth(r))
        out += [
            F.round(F.coalesce(F.col(f"hits_{k}") / F.col("n_relevant"), F.lit(0.0)), 4).alias(f"recall_{k}"),
            F.round(F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)), 4).alias(f"ndcg_{k}"),
        ]
    return m.select("query_id", "n_relevant", *out)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    cols = [c for c in per_query.columns if c not in ("query_id", "n_relevant")]
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in cols])


def baseline_status(current: DataFrame, baseline: DataFrame, metrics: list[str], slack: float = 0.02) -> DataFrame:
    """(metric, current, baseline, delta) rows with the run's status: regressed, improved or ok."""
    melt = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    d = melt(current, "current").join(melt(baseline, "baseline"), "metric", "left").withColumn("delta", F.round(F.col("current") - F.col("baseline"), 4))
    s = d.agg(F.min("delta").alias("lo"), F.max("delta").alias("hi"))
    status = F.when(F.col("lo") < -slack, "regressed").when(F.col("hi") > slack, "improved").otherwise("ok")
    return d.crossJoin(F.broadcast(s.select(status.alias("status"))))  # one row


def run_rates(golden: DataFrame, per_query: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row over golden queries (query_id, negative): share of positives with a hit and with all hits among the first five, share
    whose list the relevance floor rejected, and share of negatives rejected or left without candidates. `ranked` has
    (query_id, rejected). Empty sides count 0."""
    floor = ranked.groupBy("query_id").agg(F.bool_or("rejected").alias("rejected"))
    q = golden.join(per_query.select("query_id", "recall_5"), "query_id", "left").join(floor, "query_id", "left")
    pos, neg = ~F.col("negative"), F.col("negative")
    share = lambda side, c: F.round(F.coalesce(F.avg(F.when(side, c.cast("double"))), F.lit(0.0)), 4)
    found, gone = F.coalesce("recall_5", F.lit(0.0)), F.coalesce("rejected", F.lit(True))
    return q.agg(
        F.count_if(pos).alias("n_positive"), F.count_if(neg).alias("n_negative"), share(pos, found > 0).alias("hit_rate"), share(pos, found >= 1).alias("full_hit_rate"),
        share(pos, F.coalesce("rejected", F.lit(False))).alias("below_floor_rate"), share(neg, gone).alias("correct_rejection_rate"),
    )


def corpus_golden(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, query, relevant) of an evaluation corpus (doc_id, queries): every chunk of a document is relevant to its queries."""
    rel = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
    q = documents.select("doc_id", F.posexplode("queries").alias("n", "query"))
    return q.join(rel, "doc_id", "left").select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), (F.col("n") + 1).cast("string")).alias("query_id"), "query", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))


def containing(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "query_id", phrase: str = "query") -> DataFrame:
    """(item, key) of the items, a stated set, whose whole text a document holds, character for character. All items are looked
    for in one pass by an automaton; more than BLOCK_BYTES of them in several. Null and empty items are in no document; keys and
    items are longs."""
    given = items.where(F.length(phrase) > 0).select(F.col(item).cast("long").alias("i"), F.col(phrase).alias("p"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for n in range(blocks):
        some = [tuple(r) for r in given.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == n).collect()]  # about BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton()
            for i, p in some:
                found.add_word(p, [*found.get(p, []), i])
            found.make_automaton()
            for b in batches:
                hits = [(i, k) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True) for i in sorted({i for _, held in (found.iter(t) if some else ()) for i in held})]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([k for _, k in hits], pa.int64())], names=[item, key])

        part = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{item}` long, `{key}` long")
        out = part if out is None else out.unionByName(part)
    return out


def full_run(queries: DataFrame, golden: DataFrame, candidates: DataFrame, delivered: DataFrame, ks: tuple[int, ...] = (1, 3, 5), pool_ks: tuple[int, ...] = (1, 3, 5, 10, 20), key: str = "doc_id") -> DataFrame:
    """One row for a whole run over `queries` (query_id): those in `golden` (query_id, key) are positive, others negative. `delivered`
    has (query_id, key, rank, rejected) of what reranking kept, `candidates` (query_id, key, rank) of the pool. Recall, NDCG and MRR
    are of what was delivered, over the positives; candidate recall is of the pool; a negative is rejected rightly where nothing
    relevant was delivered, and `negative_floor_rate` is the share of negatives that the floor stopped. Empty sides count 0."""
    sent = ranking_metrics(delivered.where(~F.col("rejected")), golden, (*ks, 1 << 30), key).withColumnRenamed(f"recall_{1 << 30}", "whole")
    pool = ranking_metrics(candidates, golden, pool_ks, key).select("query_id", *[F.col(f"recall_{k}").alias(f"candidate_recall_{k}") for k in pool_ks])
    below = delivered.groupBy("query_id").agg(F.bool_or("rejected").alias("below"))
    q = queries.select("query_id").join(sent, "query_id", "left").join(pool, "query_id", "left").join(below, "query_id", "left")
    pos, neg = F.col("n_relevant").isNotNull(), F.col("n_relevant").isNull()
    share = lambda side, c: F.round(F.coalesce(F.avg(F.when(side, c.cast("double"))), F.lit(0.0)), 4)
    own = [*[f"recall_{k}" for k in ks], *[f"ndcg_{k}" for k in ks], *[f"candidate_recall_{k}" for k in pool_ks], "mrr"]
    below = F.coalesce("below", F.lit(False))
    return q.agg(
        F.count_if(pos).alias("n_positive"), F.count_if(neg).alias("n_negative"), *[share(pos, F.col(c)).alias(c) for c in own], share(pos, F.col("mrr") > 0).alias("hit_rate"),
        share(pos, F.col("whole") >= 1).alias("full_hit_rate"), share(pos, below).alias("below_floor_rate"), share(neg, F.coalesce("mrr", F.lit(0.0)) == 0).alias("correct_rejection_rate"), share(neg, below).alias("negative_floor_rate"),
    )
