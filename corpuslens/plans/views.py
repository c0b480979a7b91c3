"""Views of the given tables that play the engine's tables: the same rule for Spark and for the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "timestamp'2024-07-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit("2024-07-01").cast("timestamp")


def document_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("kb_id"), F.element_at(F.array(*map(F.lit, ("standard", "case", "enterprise"))), (i % 3 + 1).cast("int")).alias("domain"),
        F.sha2("text", 256).alias("file_hash"), F.substring("text", 1, 60).alias("title"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("u"), i % 5)).alias("owner"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(i.cast("int"))).alias("expire_date"), (F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(i.cast("int"))).alias("updated_at"),
        F.when(i % 10 == 0, "deprecated").when(i % 10 == 1, "need_update").otherwise("valid").alias("governance_status"),
        F.when(i % 23 == 0, "failed").otherwise("ready").alias("status"), F.when(i % 11 == 0, "").otherwise(F.substring("text", 1, 40)).alias("summary"), (i % 50 == 0).alias("is_deleted"),
    )


def query_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    intents = F.array(*map(F.lit, ("spec_lookup", "quality_diagnosis", "scheme_generation", "case_retrieval", "chitchat", "unknown")))
    return (
        table(spark, sf_dir, "conversations").where("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("query"), F.element_at(intents, ((c + t) % 6 + 1).cast("int")).alias("intent"), ((c + t) % 4).alias("hit_count"),
                (((c * 31 + t * 17) % 100) / 100.0).alias("confidence"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), c.cast("int"))).alias("created_at"), ((c * 7 + t * 13) % 3000).alias("latency_ms"))
        .withColumn("answered", (F.col("hit_count") > 0) & (F.col("confidence") > 0))
    )


#: The same views in the SQL that checks the queries.
SQL = {
    "document_v": """SELECT doc_id, text, source AS kb_id, ['standard','case','enterprise'][doc_id % 3 + 1] AS domain, sha256(text) AS file_hash,
        substring(text, 1, 60) AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('u', doc_id % 5) END AS owner,
        timestamp '2024-01-01' + to_days(doc_id::int) AS expire_date, timestamp '2023-01-01' + to_days(doc_id::int) AS updated_at,
        CASE WHEN doc_id % 10 = 0 THEN 'deprecated' WHEN doc_id % 10 = 1 THEN 'need_update' ELSE 'valid' END AS governance_status,
        CASE WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 11 = 0 THEN '' ELSE substring(text, 1, 40) END AS summary,
        doc_id % 50 = 0 AS is_deleted FROM documents""",
    "query_v": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "query_log_v": """SELECT *, hit_count > 0 AND confidence > 0 AS answered FROM (SELECT conv_id, turn, text AS query,
        ['spec_lookup','quality_diagnosis','scheme_generation','case_retrieval','chitchat','unknown'][(conv_id + turn) % 6 + 1] AS intent,
        (conv_id + turn) % 4 AS hit_count, ((conv_id * 31 + turn * 17) % 100) / 100.0::double AS confidence, timestamp '2024-01-01' + to_hours(conv_id::int) AS created_at,
        (conv_id * 7 + turn * 13) % 3000 AS latency_ms FROM conversations WHERE role = 'user')""",
}


def sql(body: str, *views: str, **more: str) -> str:
    """`body` after the views it names and further common table expressions."""
    ctes = [f"{v} AS ({SQL[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
