"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(big: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """keys, _splits: the keys with more than a fair partition's share of ``big``, at most one per shuffle partition, and how many shares."""
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # The total is a scalar subquery: computed once, used as a constant.
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.select(*keys, F.col("n").alias("_n"), total.alias("_total"))
        .filter(F.col("_n") * parts > F.col("_total"))
        .select(*keys, F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("_splits"))
    )


def split_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    how: str = "inner",
    look: bool = False,
) -> DataFrame:
    """Join many rows per key (``big``) with one row per key (``small``).

    A key with more than a fair partition's share of ``big`` is cut into as many
    pieces as it holds shares, by a hash of the ``spread`` columns (all plain
    columns unless given; the hash keeps retried tasks consistent), and its
    ``small`` row is repeated once per piece. With P shuffle partitions at most
    P keys can exceed a share, and the pieces add up to at most 2 P, so the
    broadcast table of hot keys is bounded by P rows whatever the data size.
    ``counts`` (keys, n) may be passed when it is known already. With ``look``
    (for counts that are written) they are read first, and rows that are dealt
    by the keys already are not dealt again if no key exceeds a share.
    """
    keys = list(keys)
    if look and hot_keys(big, keys, counts).isEmpty():
        return big.join(small, keys, how)
    if spread is None:
        spread = [c for c, kind in big.dtypes if not kind.startswith(("array", "map", "struct"))]
    hot = F.broadcast(hot_keys(big, keys, counts))
    piece = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_splits")).cast("int"), F.lit(0))
    left = big.join(hot, keys, "left").withColumn("_split", piece).drop("_splits")
    copies = F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)
    right = small.join(hot, keys, "left").withColumn("_split", F.explode(copies)).drop("_splits")
    return left.join(right, [*keys, "_split"], how).drop("_split")
