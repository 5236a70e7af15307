"""Ordered buckets of bounded size from approximate quantiles.

Only the borders (their number is a parameter) reach the driver. They go into
the plan as constants, so a retried task puts every row in the same bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def borders(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Sorted inner borders; a value that fills several buckets is repeated."""
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10 * buckets)).first()
    return sorted(row[0] or [])


def add_bucket(df: DataFrame, value: str, inner: list[float], name: str) -> DataFrame:
    """Bucket number of a column, non-decreasing in its value."""
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    cast = df.withColumn("_bv", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_bv", outputCol=name, handleInvalid="keep").transform(cast)
    return out.withColumn(name, F.col(name).cast("bigint")).drop("_bv")


def add_order_chunk(df: DataFrame, first: str, second: str | None, name: str) -> DataFrame:
    """Chunk number, non-decreasing in (first, second).

    A chunk of one key holds at most about one bucket's share of all rows. A
    single ``first`` value that alone fills more than a bucket is cut further by
    the ``second`` column.
    """
    n = bucket_count(df)
    inner = borders(df, first, n)
    heavy = sorted({v for v in inner if inner.count(v) > 1})
    out = add_bucket(df, first, inner, "_b1")
    if not heavy or second is None:
        return out.withColumnRenamed("_b1", name)
    out = add_bucket(out, second, borders(df, second, n), "_b2")
    # A heavy value is the lowest of its bucket; the rows above it come last.
    tied: Column = F.col(first).cast("double").isin(heavy)
    inside = F.when(tied, F.col("_b2")).otherwise(F.lit(n + 1))
    return out.withColumn(name, F.col("_b1") * (n + 2) + inside).drop("_b1", "_b2")
