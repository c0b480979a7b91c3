"""Tables stored in slices of knowledge bases, of which a change writes only those it touches.

A document's slice follows from its key. Each change writes new folders, of the slices it touches alone, and then one small
manifest that names the folder of every slice: readers take the newest manifest, so a change is seen whole or not at all, no
plan overwrites what it reads, and older versions stay readable. A reader joins the manifest, one row for each slice, on the
partition columns, so that Spark prunes folders at run time; a scope of knowledge bases narrows the manifest first.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "kb_id string, slice int, batch string, n_slices int, n_docs long, total long, version int"
#: Documents of a slice at the time a knowledge base is first written, and rows of a manifest that are broadcast.
SLICE_DOCS, BROADCAST_ROWS = 50_000, 1_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; one of our own only on a local master whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slice_of(key: Column, n_slices: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_slices).cast("int")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast where it counts at most `rows` rows; else left to the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: computed once, and there for executors that come later."""
    path = shared_folder(df.sparkSession, name)
    # The shuffle files of a write are of no use once the table is there; without this they stay until the driver collects garbage.
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetched(docs: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """The documents that `rows` name, as a table: they are picked where they are read, so that no other text is moved."""
    return written(docs.join(small(rows.select(key).distinct()), key, "left_semi"), name)


@dataclass(frozen=True)
class Sliced:
    """Stored tables of one path, as of `version`; the newest where that is None."""

    spark: SparkSession
    path: str
    version: int | None = None

    def manifest(self, scope: DataFrame | None = None) -> DataFrame:
        """(kb_id, slice, batch, n_slices, n_docs, total); of the knowledge bases in `scope` (kb_id) only, where given."""
        every = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        version = self.version if self.version is not None else every.agg(F.max("version")).first()[0]
        m = every.where(F.col("version") == F.lit(version)).drop("version").where("slice >= 0")
        return m if scope is None else m.join(scope.select("kb_id").distinct(), "kb_id", "left_semi")

    def last_version(self) -> int:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return -1

    def rows(self, name: str, schema: str, slices: DataFrame) -> DataFrame:
        """Rows of table `name` in the given slices (kb_id, slice, batch)."""
        stored = self.spark.read.schema(f"{schema}, batch string, kb_id string, slice int").parquet(f"{self.path}/{name}")
        return stored.join(small(slices.select("kb_id", "slice", "batch")), ["kb_id", "slice", "batch"])

    def write(self, name: str, rows: DataFrame, batch: str, order: list[str]) -> None:
        """One file for each slice, in an order by which row groups can be skipped; without an order, rows that are dealt so already."""
        dealt = rows.repartition("kb_id", "slice").sortWithinPartitions("kb_id", "slice", *order) if order else rows
        dealt.write.partitionBy("kb_id", "slice").parquet(f"{self.path}/{name}/batch={batch}")

    def commit(self, slices: DataFrame, **beside: DataFrame) -> int:
        """Make `slices` the current ones, with small tables `beside` them; the new version's number."""
        version = self.last_version() + 1
        for name, df in beside.items():
            df.coalesce(1).write.parquet(f"{self.path}/{name}/version={version}")
        mark = self.spark.createDataFrame([("", -1, "", 0, 0, 0)], MANIFEST.rsplit(",", 1)[0])  # a version without any slice is one too
        slices.select(*mark.columns).unionByName(mark).coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")
        return version

    def beside(self, name: str, schema: str) -> DataFrame:
        version = self.version if self.version is not None else self.last_version()
        return self.spark.read.schema(f"{schema}, version int").parquet(f"{self.path}/{name}").where(F.col("version") == F.lit(version)).drop("version")

    def dealt(self, rows: DataFrame, held: DataFrame, key: str, slice_docs: int = SLICE_DOCS) -> DataFrame:
        """`rows` with their slice: knowledge bases of the manifest `held` keep their number of slices, new ones get one by size."""
        known = held.groupBy("kb_id").agg(F.first("n_slices").alias("n_slices"))
        count = rows.groupBy("kb_id").agg(F.count("*").alias("n")).join(known, "kb_id", "left")
        n = count.select("kb_id", F.coalesce("n_slices", F.ceil(F.col("n") / slice_docs).cast("int")).alias("n_slices"))
        return rows.join(small(n), "kb_id").withColumn("slice", slice_of(F.col(key), F.col("n_slices")))
