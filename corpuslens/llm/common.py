"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: keeps a Python worker's memory bounded when texts are very long.
BATCH_ROWS = 200


_HELD: dict = {}


def held(build, *key):
    """What `build(*key)` gave, kept in this worker process until something else is: one operator's tables at a time."""
    if (build, *key) not in _HELD:
        _HELD.clear()
        _HELD[build, *key] = build(*key)
    return _HELD[build, *key]


def release() -> None:
    """Let go of the tables that an operator before left in this worker process."""
    _HELD.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only on a local master whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    # The shuffle files of a write are of no use once the table is there; without this they stay until the driver collects garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def hash_unit(col: str | Column, seed: str = "") -> Column:
    """A number in [0, 1) that depends on the value alone: for samples that are the same in every run."""
    key = F.concat(F.lit(seed), (F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.crc32(F.md5(key.cast("binary")).cast("binary")) / F.lit(2.0**32)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The operator's own columns, so that extra ones with any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def with_small(df: DataFrame, ids: DataFrame, key: str | list[str], how: str, limit: int = 1_000_000) -> DataFrame:
    """Semi or anti join against a key set: broadcast while it counts at most `limit` keys, else a shuffle join."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids.hint("merge"), key, how)
