"""Exact union area of rectangles as bit masks per tile.

A rectangle is cut into the tiles it touches and each piece becomes a few
64-bit masks, merged by ``bit_or``. Rectangles are shuffled by their key and cut
behind the shuffle, as masks are much larger. A key with more than a fair
partition's share of them is cut where it lies, and its masks combine before the
shuffle, so a crowded screen costs one row per touched tile and task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.operators.skew import hot_keys


def tile_coverage(
    rects: DataFrame, keys: Sequence[str], tile_h: int, tile_w: int
) -> DataFrame:
    """Covered unit cells per tile: (keys, tile_row, tile_col, covered).

    ``rects`` has half-open integer ranges r0..r1 (rows) and c0..c1 (columns),
    all non-negative. Tiles without coverage are not listed.
    """
    if tile_w > 62:
        raise ValueError("tile_w must fit a 64-bit mask")
    filled = rects.filter("r1 > r0 AND c1 > c0").select(*keys, "r0", "r1", "c0", "c1")
    hot = F.broadcast(hot_keys(filled, keys))
    light = _merged(filled.join(hot, keys, "left_anti").repartition(*keys), keys, tile_h, tile_w)
    return light.unionAll(_merged(filled.join(hot, keys, "left_semi"), keys, tile_h, tile_w))


def _merged(rects: DataFrame, keys: Sequence[str], tile_h: int, tile_w: int) -> DataFrame:
    per_word = max(1, 62 // tile_w)
    words = math.ceil(tile_h / per_word)
    repeats = [sum(1 << (i * tile_w) for i in range(n)) for n in range(per_word + 1)]
    pieces = (
        rects.withColumn("tile_row", F.explode(F.expr(f"sequence(r0 div {tile_h}, (r1 - 1) div {tile_h})")))
        .withColumn("tile_col", F.explode(F.expr(f"sequence(c0 div {tile_w}, (c1 - 1) div {tile_w})")))
        .selectExpr(
            *keys,
            "tile_row",
            "tile_col",
            f"cast(greatest(r0 - tile_row * {tile_h}, 0) as int) as _r0",
            f"cast(least(r1 - tile_row * {tile_h}, {tile_h}) as int) as _r1",
            f"cast(greatest(c0 - tile_col * {tile_w}, 0) as int) as _c0",
            f"cast(least(c1 - tile_col * {tile_w}, {tile_w}) as int) as _c1",
        )
        .withColumn("_line", F.expr("shiftleft(shiftleft(1L, _c1 - _c0) - 1L, _c0)"))
    )
    table = ", ".join(f"{r}L" for r in repeats)
    masks = []
    for i in range(words):
        first, last = i * per_word, (i + 1) * per_word
        if per_word == 1:
            masks.append(f"bit_or(if(_r0 <= {i} AND _r1 > {i}, _line, 0L)) as _w{i}")
            continue
        lo, hi = f"greatest(_r0, {first})", f"least(_r1, {last})"
        masks.append(
            f"bit_or(if({hi} > {lo}, shiftleft(_line * element_at(array({table}), {hi} - {lo} + 1),"
            f" ({lo} - {first}) * {tile_w}), 0L)) as _w{i}"
        )
    merged = pieces.groupBy(*keys, "tile_row", "tile_col").agg(*[F.expr(m) for m in masks])
    covered = " + ".join(f"bit_count(_w{i})" for i in range(words))
    return merged.selectExpr(*keys, "tile_row", "tile_col", f"cast({covered} as bigint) as covered")
