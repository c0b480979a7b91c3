"""Checkpoints of knowledge bases, roll back, and deletion that reaches chunks and indexes. Members are rows, not lists, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.ingest import reindexed


def checkpoint(docs: DataFrame, versions: DataFrame, kb_key: str = "kb_id") -> tuple[DataFrame, DataFrame]:
    """(kb_id, version_no, n_docs) of new versions of all knowledge bases with live documents, and their members (kb_id, version_no, doc_id).
    Numbers go on from the largest of each knowledge base in `versions` (kb_id, version_no)."""
    last = versions.groupBy(kb_key).agg(F.max("version_no").alias("last"))
    live = docs.where(~F.coalesce("is_deleted", F.lit(False)))
    new = live.groupBy(kb_key).agg(F.count("*").alias("n_docs")).join(last, kb_key, "left")
    new = new.select(kb_key, (F.coalesce("last", F.lit(0)) + 1).alias("version_no"), "n_docs")
    return new, live.select(kb_key, "doc_id").join(new.select(kb_key, "version_no"), kb_key).select(kb_key, "version_no", "doc_id")


def set_deleted(rows: DataFrame, doc_ids: DataFrame, deleted: bool) -> DataFrame:
    """Documents, chunks or other rows with doc_id, those of `doc_ids` deleted or restored."""
    hit = doc_ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "doc_id", "left").withColumn("is_deleted", F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("is_deleted"))).select(*rows.columns)


def cascade(docs: DataFrame, chunks: DataFrame, doc_ids: DataFrame, deleted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents and their chunks after deletion or restoration; index rows of deleted ones go with `sources.tables.remove_by_key`."""
    return set_deleted(docs, doc_ids, deleted), set_deleted(chunks, doc_ids, deleted)


def rolled_back(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, posts: DataFrame, version: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, chunks, vectors and postings of the knowledge bases of a version (kb_id, doc_id): documents that are not
    its members are deleted with their chunks and index rows, deleted members come back and are indexed anew."""
    scope = docs.join(version.select("kb_id").distinct(), "kb_id", "left_semi").select("doc_id", "is_deleted")
    live = scope.where(~F.coalesce("is_deleted", F.lit(False))).select("doc_id")
    gone, back = live.join(version, "doc_id", "left_anti"), scope.where("is_deleted").join(version.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    docs, chunks = cascade(*cascade(docs, chunks, gone), back, deleted=False)
    return docs, chunks, *reindexed(vectors, posts, chunks, gone.unionByName(back))


def resolve_alerts(alerts: DataFrame, tasks: DataFrame, resolved: DataFrame, links: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Alerts of `resolved` (alert_id) set resolved, and their linked tasks (alert_id, task_id) that are open or in work set done."""
    hit = resolved.select("alert_id").distinct()
    a = alerts.join(hit.withColumn("_hit", F.lit(True)), "alert_id", "left").withColumn("resolved", F.coalesce("_hit", "resolved")).select(*alerts.columns)
    done = links.join(hit, "alert_id").select("task_id").distinct().withColumn("_hit", F.lit(True))
    closes = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("status").isin("open", "processing")
    t = tasks.join(done, "task_id", "left").withColumns({"status": F.when(closes, "done").otherwise(F.col("status")), "updated_at": F.when(closes, at).otherwise(F.col("updated_at"))})
    return a, t.select(*tasks.columns)


def with_assignee(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """Tasks whose empty assignee is the owner of their document."""
    own = docs.select("doc_id", "owner")
    mine = F.when(F.coalesce(F.trim("assignee"), F.lit("")) == "", F.coalesce("owner", F.lit(""))).otherwise(F.col("assignee"))
    return tasks.join(own, "doc_id", "left").withColumn("assignee", mine).drop("owner")
