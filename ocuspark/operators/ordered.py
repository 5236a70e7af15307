"""Ordered processing of long keyed series without one task per key.

A window partitioned by recording alone puts a whole recording in one task, so
a single recording that holds a third of the rows would stall the job. Here a
series is cut into blocks of a fixed number of rows:

1. ``number_rows`` gives every row its position in the series. Row numbers are
   taken inside order chunks of bounded size and shifted by the sizes of the
   earlier chunks (one small row per chunk).
2. ``with_halo`` assigns rows to blocks and copies the few rows on either side
   of a block boundary to the neighbour, so bounded look-around (lag, lead,
   seven-sample medians) needs only ``(key, block)`` windows.
3. ``running`` extends an unbounded running max or sum over the blocks with a
   carry table of two rows per block.

The blocks are deterministic functions of the rows, so a recomputed task after
a lost executor produces the same blocks again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.operators.buckets import add_order_chunk

BLOCK_ROWS = 100_000
ALL_BEFORE = Window.unboundedPreceding


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    mins: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``rn`` (1-based position within the key) and per-key minima.

    Chunks are quantile buckets of the (numeric) order columns, so a chunk of one
    key holds at most about one partition's share of all rows. A ``chunk``
    expression that is non-decreasing in ``order`` may be given instead.
    """
    mins = mins or {}
    if chunk is None:
        chunked = add_order_chunk(df, order[0], order[1] if len(order) > 1 else None, "_chunk")
    else:
        chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_m_{n}") for n, c in mins.items()]
    )
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_chunk").rowsBetween(ALL_BEFORE, -1)
    offsets = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[F.min(f"_m_{n}").over(per_key).alias(n) for n in mins],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_i", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("rn", F.col("_before") + F.col("_i"))
        .drop("_chunk", "_i", "_before")
    )


def with_halo(df: DataFrame, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block``, ``own`` and ``tail``; boundary rows also go to the neighbour.

    ``own`` marks the one copy of a row that belongs to its block, ``tail`` the
    last ``halo`` positions of a block.
    """
    if block_rows <= 2 * halo:
        raise ValueError("block_rows must exceed twice the halo")
    home = F.floor((F.col("rn") - 1) / block_rows).cast("bigint")
    offset = (F.col("rn") - 1) % block_rows
    tail = offset >= block_rows - halo
    targets = F.array_compact(
        F.array(
            home,
            F.when((offset < halo) & (home > 0), home - 1),
            F.when(tail, home + 1),
        )
    )
    return (
        df.withColumn("_home", home)
        .withColumn("tail", tail)
        .withColumn("block", F.explode(targets))
        .withColumn("own", F.col("block") == F.col("_home"))
        .drop("_home")
    )


def shrink(df: DataFrame, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Narrow the halo to ``halo`` rows once the outer ones lack context.

    Look-around results are incomplete on the outermost copies; they must not
    enter a running value, so they are dropped here.
    """
    first, last = F.col("block") * block_rows + 1, (F.col("block") + 1) * block_rows
    return df.filter(F.col("rn").between(first - halo, last + halo)).withColumn(
        "tail", F.col("own") & (F.col("rn") > last - halo)
    )


def block_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "block").orderBy("rn")


def half_blocks() -> Column:
    """Order index of the two parts of a block: body (even) and tail (odd)."""
    return F.col("block") * 2 + F.col("tail").cast("bigint")


def carry_to_next(parts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Prefix values after a block's body, keyed by the block that follows.

    The next block's window starts with the copied tail rows, so what it must
    know is the state just before that tail.
    """
    return parts.filter(F.col("_part") % 2 == 0).select(
        *keys, (F.floor(F.col("_part") / 2) + 1).cast("bigint").alias("block"), *names
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    strict: bool = False,
) -> DataFrame:
    """Running max / sum over the whole series for a frame made by ``with_halo``.

    ``specs`` maps the output name to (``"max"`` | ``"sum"``, expression).
    ``strict`` leaves the current row out of its own running value.
    """
    agg = {"max": F.max, "sum": F.sum}
    parts = (
        df.filter("own")
        .withColumn("_part", half_blocks())
        .groupBy(*keys, "_part")
        .agg(*[agg[kind](expr).alias(f"_c_{n}") for n, (kind, expr) in specs.items()])
    )
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(ALL_BEFORE, 0)
    prefix = parts.select(
        *keys,
        "_part",
        *[agg[kind](f"_c_{n}").over(upto).alias(f"_c_{n}") for n, (kind, _) in specs.items()],
    )
    carry = carry_to_next(prefix, keys, [f"_c_{n}" for n in specs])
    w = block_window(keys).rowsBetween(ALL_BEFORE, -1 if strict else 0)
    local = df.select(
        "*", *[agg[kind](expr).over(w).alias(f"_l_{n}") for n, (kind, expr) in specs.items()]
    )
    out = local.join(carry, [*keys, "block"], "left")
    for n, (kind, _) in specs.items():
        here, before = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        value = (
            F.greatest(here, before)
            if kind == "max"
            else F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        )
        out = out.withColumn(n, value).drop(f"_l_{n}", f"_c_{n}")
    return out


def prefix_over_blocks(
    df: DataFrame, keys: Sequence[str], name: str, kind: str, expr: Column
) -> DataFrame:
    """One row per (key, block): the aggregate of all earlier blocks."""
    agg = {"max": F.max, "sum": F.sum}[kind]
    per_block = df.groupBy(*keys, "block").agg(agg(expr).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(ALL_BEFORE, -1)
    return per_block.select(*keys, "block", agg("_v").over(before).alias(name))
