"""Exact ranks and quantiles without one task per group.

``cumulative`` first collapses equal values (so copies cost one row), cuts the
value range into buckets of bounded size and adds up counts inside a bucket and
over the earlier buckets. The bucket borders are approximate quantiles: only
their number, not the data, reaches the driver, and they affect the balance of
the work, never the result. They are taken over the distinct values, so a value
that makes up most rows cannot push all others into one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.operators.buckets import add_bucket, borders, bucket_count
from ocuspark.operators.lineage import cut
from ocuspark.operators.skew import split_join

ALL = Window.unboundedPreceding


def cumulative(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weights: dict[str, Column],
    buckets: int | None = None,
) -> DataFrame:
    """One row per (groups, distinct value) with running sums of the weights.

    For every weight ``w`` the result has ``w`` (sum at this value),
    ``w_before`` (sum over smaller values of the group) and ``w_total``.
    Null values are left out.
    """
    if buckets is None:
        buckets = bucket_count(df)
    groups = list(groups)
    names = list(weights)
    distinct = cut(
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias(value))
        .agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    )
    rows = add_bucket(distinct, value, borders(distinct, value, buckets), "_bucket")
    per_bucket = rows.groupBy(*groups, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(ALL, -1)
    offsets = per_bucket.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in names],
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(ALL, -1)
    local = rows.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_l_{n}") for n in names]
    )
    joined = local.join(offsets, [*groups, "_bucket"])
    return joined.select(
        *groups,
        value,
        *names,
        *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
    )


def quantile_name(p: float) -> str:
    return f"p{round(p * 100)}"


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    buckets: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, columns ``p5``, ``p50`` …"""
    ranked = cumulative(df, groups, value, {"n": F.lit(1)}, buckets)
    aggs = []
    for p in probs:
        pos = (F.col("n_total") - 1) * F.lit(float(p))
        low = F.floor(pos)
        covers = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        aggs += [
            F.max(F.when(covers(low), F.col(value))).alias(f"_lo_{quantile_name(p)}"),
            F.max(F.when(covers(F.ceil(pos)), F.col(value))).alias(f"_hi_{quantile_name(p)}"),
            F.max(pos - low).alias(f"_f_{quantile_name(p)}"),
        ]
    wide = ranked.groupBy(*groups).agg(*aggs)
    out = []
    for p in probs:
        q = quantile_name(p)
        lo, hi, f = F.col(f"_lo_{q}"), F.col(f"_hi_{q}"), F.col(f"_f_{q}")
        out.append((lo + (hi - lo) * f).alias(q))
    return wide.select(*groups, *out)


def average_ranks(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values with their 1-based average rank over the whole table."""
    ranked = cumulative(df, [], value, {"n": F.lit(1)}, buckets)
    return ranked.select(value, (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Spearman's rho with average ranks for ties, and the pair count."""
    # Cut: read three times and joined by value, so its values must not be computed anew.
    pairs = cut(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)
    ))
    rx = average_ranks(pairs, x).withColumnRenamed("rank", "_rx")
    ry = average_ranks(pairs, y).withColumnRenamed("rank", "_ry")
    # A tied value may hold a large share of the rows; the other column spreads it.
    ranked = split_join(split_join(pairs, rx, [x], [y]), ry, [y], [x])
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))
