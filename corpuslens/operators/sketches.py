"""Quantile sketches that add up: counts by logarithmic buckets, stored by hour and group and merged over any window.

Bucket i holds the values in (g^(i-1), g^i] with g = (1 + ACCURACY) / (1 - ACCURACY); values of 0 and below have bucket ZERO. A
quantile is read as 2 g^i / (g + 1) of its bucket, which is off by ACCURACY of the value at most. A sketch is a few hundred
rows for each hour and group at most, however many values it is of, and sketches of parts add up to that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 0.01
ZERO = -(1 << 30)


def _base(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def sketch(rows: DataFrame, value: str, by: list[Column], accuracy: float = ACCURACY) -> DataFrame:
    """(by, bucket, n) of the values that are not null."""
    v = F.col(value).cast("double")
    at = F.when(v > 0, F.ceil(F.round(F.log(v) / F.log(F.lit(_base(accuracy))), 9)).cast("int")).otherwise(ZERO)
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, at.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str], rollup: bool = False) -> DataFrame:
    """The sketches of larger groups; with `rollup`, of every prefix of `by` as well, whose missing columns are null and whose
    `level` counts them."""
    if not rollup:
        return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    out = None
    for k in range(len(by) + 1):
        kept = by[: len(by) - k]
        gone = [F.lit(None).cast(sketches.schema[c].dataType).alias(c) for c in by[len(by) - k :]]
        part = sketches.groupBy(*kept, "bucket").agg(F.sum("n").alias("n")).select(*kept, *gone, F.lit(k).alias("level"), "bucket", "n")
        out = part if out is None else out.unionByName(part)
    return out


def quantiles(sketches: DataFrame, by: list[str], qs: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: float = ACCURACY) -> DataFrame:
    """(by, n, a column for each of `qs`): the value at rank ceil(q n), within `accuracy` of it. Groups may be null."""
    w = W.partitionBy(*by).orderBy("bucket")
    s = sketches.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    read = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(_base(accuracy)), F.col("bucket")) / (_base(accuracy) + 1))
    each = [F.min_by(F.when(F.col("upto") >= F.ceil(q * F.col("total")), read), F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("bucket"))).alias(f"p{round(q * 100)}") for q in qs]
    return s.groupBy(*by).agg(F.sum("n").alias("n"), *each)


def exact_quantiles(rows: DataFrame, value: str, by: list[Column], qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, n, a column for each of `qs`) by interpolation between the two nearest values, of values that are not null."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(v, q).alias(f"p{round(q * 100)}") for q in qs])
