"""Sources and sinks of documents, golden sets and snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T

SUFFIXES = ("txt", "md", "markdown", "csv")
LARGEST = 100 << 20


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text and Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def admission(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, largest: int = LARGEST) -> DataFrame:
    """(path, length, reason) of files; reason is null for those admitted."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ends = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.withColumn("reason", F.when(~ends.isin(*suffixes), "suffix").when(F.col("length") > largest, "size"))


def csv_tables(spark: SparkSession, path: str, rows: int = 40) -> DataFrame:
    """(path, block, text): Markdown tables of up to `rows` data rows, each with the header, which is the first line that is not blank;
    blank lines are dropped. Cells may be quoted, with quotes doubled inside; quoted line breaks are not known."""
    filled = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(F.translate(x, ',"', "")) != "")
    lines = text_documents(spark, path).select("path", F.posexplode(filled).alias("pos", "line"))
    each = F.regexp_extract_all(F.concat("line", F.lit(",")), F.lit(r'\s*("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    cell = lambda c: F.trim(F.when(c.rlike(r'^".*"$'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    cells = lines.withColumn("cells", F.transform(each, cell))
    cells = cells.withColumn("row", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))).withColumn("n", F.size("cells"))
    head = cells.where("pos = 0").select("path", F.col("row").alias("head"), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n"))).alias("rule"))
    body = cells.where("pos > 0").withColumn("block", F.floor((F.col("pos") - 1) / rows))
    body = body.groupBy("path", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("rows"))
    return body.join(head, "path").select("path", "block", F.concat_ws("\n", "head", "rule", F.array_join("rows", "\n")).alias("text"))


def golden_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path).select(F.explode("items").alias("i")).select("i.*")


def replace_by_key(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows take the place of those with their keys."""
    return base.join(rows.select(*key), key, "left_anti").unionByName(rows)


def remove_by_key(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Each non-null field of `changes` (a row for each key at most) replaces that of `base`; changed rows get `updated_at`."""
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in changes.columns if x != key], F.lit(True).alias("changed"))
    j = base.join(c, key, "left")
    return j.select(*[
        F.when(F.col("changed"), stamp).otherwise(F.col(x)).alias(x) if x == "updated_at"
        else F.coalesce(f"new_{x}", x).alias(x) if x in changes.columns and x != key else F.col(x) for x in base.columns
    ])


def write_partitions(df: DataFrame, path: str, by: str = "kb_id") -> None:
    """Replace only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def add_golden(golden: DataFrame, items: DataFrame) -> DataFrame:
    """Golden set after `items` (id, query, ...): ids replace, items without id get the next free ones, g01 and on, by query."""
    top = F.coalesce(F.max(F.regexp_extract("id", r"^g(\d+)$", 1).try_cast("int")), F.lit(0))
    last = golden.agg(top.alias("last"))
    n = F.row_number().over(W.orderBy("query"))  # the few items a person adds
    fresh = items.where(T.blank(F.col("id"))).crossJoin(F.broadcast(last)).withColumn("id", F.concat(F.lit("g"), F.lpad((F.col("last") + n).cast("string"), 2, "0"))).drop("last")
    return replace_by_key(golden, items.where(~T.blank(F.col("id"))).unionByName(fresh), ["id"])


def baseline_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics (metric, value) of a baseline file with an `aggregated` object; no file gives no rows."""
    try:
        b = spark.read.option("multiLine", "true").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], "metric string, value double")
    return b.select(F.explode(F.from_json(F.to_json("aggregated"), "map<string,string>")).alias("metric", "v")).select("metric", F.col("v").try_cast("double").alias("value")).where("value IS NOT NULL")


def upsert(stored: DataFrame, rows: DataFrame, key: str = "chunk_id", vector: str | None = "vector", order: str | None = None) -> DataFrame:
    """Stored rows with `rows` in place of those with their keys; vectors are scaled to length 1. Of rows with one key the one with the
    largest `order` stays, and of those the one whose JSON is the largest, so that a rerun keeps the same."""
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*rows.columns)))
    new = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in rows.columns])
    if vector:
        v = F.col(vector).cast("array<double>")
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        new = new.withColumn(vector, F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))
    return replace_by_key(stored, new.select(*stored.columns), [key])


def drop_kb(rows: DataFrame, kb_ids: list[str]) -> DataFrame:
    return rows.where(~F.coalesce(F.col("kb_id").isin(*kb_ids), F.lit(False)))


def counts(rows: DataFrame) -> DataFrame:
    """Rows of an index by knowledge base."""
    return rows.groupBy("kb_id").agg(F.count("*").alias("n"))


def repartitioned(flat: DataFrame, path: str, tenant: str = "default") -> tuple[int, int]:
    """Write a flat index by knowledge base, rows without tenant given one; counts before and after, which must agree."""
    flat.withColumn("tenant_id", F.when(T.blank(F.col("tenant_id")), tenant).otherwise(F.col("tenant_id"))).write.mode("errorifexists").partitionBy("kb_id").parquet(path)
    before, after = flat.count(), flat.sparkSession.read.parquet(path).count()
    if before != after:
        raise ValueError(f"{before} rows before, {after} after")
    return before, after


def copy_tables(tables: dict[str, DataFrame], path: str, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """Copy tables that are not skipped to folders of `path` which hold no rows yet; what was done with each."""
    out = {}
    for name, df in tables.items():
        if name in skip:
            out[name] = "excluded"
            continue
        try:
            held = not df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}").isEmpty()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            held = False
        if not held:
            df.write.mode("append").parquet(f"{path}/{name}")
        out[name] = "not empty" if held else "copied"
    return out


def append_rows(rows: DataFrame, path: str, by: str = "tenant_id", run: str | None = None) -> None:
    """Add reports, alerts, runs or log rows, by tenant. Rows of a `run` replace those that an attempt before wrote for it."""
    if run is None:
        rows.write.mode("append").partitionBy(by).parquet(path)
    else:
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", by).parquet(path)
