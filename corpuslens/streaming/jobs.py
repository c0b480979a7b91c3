"""Streams: metrics by window, deduplicated ingest, and gap capture; rows later than the watermark are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuslens.functions import text as T
from corpuslens.operators.governance import capture_gaps, operation_metrics
from corpuslens.operators.quality import alerts, kb_scores, static_issues


def windowed_metrics(log: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Operation metrics by tumbling, or with `slide` sliding, windows."""
    at = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    m = operation_metrics(log.withWatermark("created_at", late), [at])
    return m.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in m.columns if c != "window"])


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    m = operation_metrics(log.withWatermark("created_at", late), [F.session_window("created_at", gap), F.col("user_id")])
    return m.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_queries", "n_unanswered")


def deduplicated(docs: DataFrame, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """The first document of each (kb_id, file_hash) within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["kb_id", "file_hash"])


def gap_capture(log: DataFrame, store: str, checkpoint: str):
    """Start a query that merges each batch of questions into snapshots of gaps; `store`/vN is the state after batch N."""
    spark = log.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{store}/v{n - 1}") if n else spark.createDataFrame([], "query_key string, n long, last_asked_at timestamp, status string")
        capture_gaps(before, batch).write.mode("overwrite").parquet(f"{store}/v{n}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


GAP = "n long, last_asked_at timestamp, status string, query string, intent string, domains string"
CHANGED = f"query_key string, {GAP}"


class GapProcessor(StatefulProcessor):
    """The gap of one query key: questions count while it is open and leave their latest text, intent and domains; a decision
    freezes it. A decided gap is forgotten `kept` after its decision, by the time of the rows, and may open again."""

    def __init__(self, kept: timedelta):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.gap = handle, handle.getValueState("gap", GAP)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.gap.get() if self.gap.exists() else None
        n, last, status, query, intent, domains = held if held is not None else (0, None, "open", None, None, None)
        events = pd.concat(list(rows), ignore_index=True).sort_values(["created_at", "decision", "query"], na_position="first", kind="stable")
        for r in events.itertuples():
            if status != "open":
                break
            if isinstance(r.decision, str):
                status = r.decision
                self.handle.registerTimer(int((r.created_at + self.kept).timestamp() * 1000))
                continue
            n += 1
            if last is None or r.created_at >= last:
                last, query, intent, domains = r.created_at.to_pydatetime(), r.query, r.intent, r.domains
        if n == 0:  # a decision on what nobody asked
            return
        self.gap.update((n, last, status, query, intent, domains))
        yield pd.DataFrame([[key[0], n, last, status, query, intent, domains]], columns=[c.split()[0] for c in CHANGED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.gap.clear()
        yield pd.DataFrame([[key[0], 0, None, "forgotten", None, None, None]], columns=[c.split()[0] for c in CHANGED.split(", ")])

    def close(self) -> None:
        pass


def stateful_gaps(log: DataFrame, store: str, checkpoint: str, late: str = "1 day", kept: timedelta = timedelta(days=90)):
    """Start a query that keeps a gap for each query key in Spark's state store; a batch writes the gaps it changed, no others, to
    `store`/batch=N, so a retried batch writes the same folder again. Rows (query, created_at, intent, domains as text, decision:
    null for a question, else the gap's new status). Rows later than the watermark are dropped. Needs the RocksDB state store."""
    rows = log.withWatermark("created_at", late).select(T.token_key(F.col("query")).alias("query_key"), "created_at", "query", "intent", "domains", "decision")
    changed = rows.groupBy("query_key").transformWithStateInPandas(GapProcessor(kept), CHANGED, "Update", "EventTime")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={n}")

    return changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gaps_so_far(spark: SparkSession, store: str) -> DataFrame:
    """The gaps after all batches: the last change of each key, without those forgotten."""
    each = spark.read.schema(f"{CHANGED}, batch long").parquet(store)
    names = [c.split()[0] for c in GAP.split(", ")]
    return each.groupBy("query_key").agg(F.max_by(F.struct(*names), "batch").alias("g")).select("query_key", "g.*").where("status <> 'forgotten'")


def periodic_inspection(chunks: DataFrame, store: str, checkpoint: str, threshold: float = 80.0):
    """Start a query that inspects each new snapshot of chunks (as `ingest.chunks` gives them, with kb_id): `store`/reports
    gets a report of each knowledge base for each batch, by `batch`, and `store`/alerts those alerts that follow from it and
    the report before. A retried batch writes the same folders again."""
    spark = chunks.sparkSession

    def inspect(batch: DataFrame, n: int) -> None:
        sizes = batch.groupBy("kb_id").agg(F.count("*").alias("n_chunks"))
        found = static_issues(batch).join(batch.select("doc_id", "seq", "kb_id").distinct(), ["doc_id", "seq"])
        r = kb_scores(found, sizes).select(F.lit(n).cast("long").alias("report_id"), F.lit("default").alias("tenant_id"), "kb_id", F.lit(n).cast("long").alias("created_at"), "score", "issue_count", "high_count")
        r.write.mode("overwrite").parquet(f"{store}/reports/batch={n}")
        every = spark.read.parquet(f"{store}/reports").where(F.col("batch") <= n)
        alerts(every, threshold).where(F.col("report_id") == n).write.mode("overwrite").parquet(f"{store}/alerts/batch={n}")

    return chunks.writeStream.foreachBatch(inspect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
