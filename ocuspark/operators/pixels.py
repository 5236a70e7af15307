"""Pixel tables (image_id, y, x, b, g, r) -> image statistics.

Histograms and integer sums are taken before anything is shuffled, so an image
leaves each task as a few hundred rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.functions.columns import clip
from ocuspark.operators.skew import split_join

KEY = ["image_id"]
# 8-bit grey and hue conversion, luminance weights, norm limits.
GREY = (3735, 19235, 9798)  # blue, green, red in 1/32768
LUMA = (0.2126, 0.7152, 0.0722)  # red, green, blue
SRGB_KNEE, SRGB_SLOPE, SRGB_SHIFT, SRGB_SCALE, SRGB_POWER = 0.03928, 12.92, 0.055, 1.055, 2.4
LIMIT_LUM, LIMIT_COLOR, LIMIT_HUE, LIMIT_SAT = 128.0, 150.0, 2.5, 0.5
CHROMA_WEIGHT, CHROMA_FLAT = 0.0625, 0.008
ELEMENT_MIN, ELEMENT_MAX, ELEMENT_ASPECT, ELEMENT_SOLIDITY = 0.0005, 0.25, 10.0, 0.3


def grey() -> Column:
    b, g, r = (F.col(c).cast("bigint") for c in "bgr")
    total = b * GREY[0] + g * GREY[1] + r * GREY[2] + 16384
    return F.shiftright(total, 15)


def hue_sat() -> tuple[Column, Column]:
    """8-bit hue (half degrees, 0..179) and saturation (0..255)."""
    b, g, r = (F.col(c).cast("bigint") for c in "bgr")
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    diff = v - low
    s_unit = F.bround(F.lit(255.0 * 4096) / F.when(v > 0, v)).cast("bigint")
    h_unit = F.bround(F.lit(180.0 * 4096 / 6) / F.when(diff > 0, diff)).cast("bigint")
    sector = F.when(v == r, g - b).when(v == g, b - r + 2 * diff).otherwise(r - g + 4 * diff)
    sat = F.coalesce(F.shiftright(diff * s_unit + 2048, 12), F.lit(0))
    raw = F.coalesce(F.shiftright(sector * h_unit + 2048, 12), F.lit(0))
    return F.when(raw < 0, raw + 180).otherwise(raw), sat


def shannon_entropy(pixels: DataFrame) -> DataFrame:
    """Entropy (bits) of the 256-level grey histogram."""
    hist = pixels.groupBy(*KEY, grey().alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
    per = hist.groupBy(*KEY).agg(
        F.sum("_c").alias("_n"),
        F.sum(F.col("_c") * F.log2(F.col("_c").cast("double"))).alias("_s"),
    )
    return per.select(
        *KEY,
        (F.log2(F.col("_n").cast("double")) - F.col("_s") / F.col("_n")).alias("shannon_entropy"),
    )


def layout_symmetry(pixels: DataFrame) -> DataFrame:
    """Mean of the left-right and top-bottom mirrored autocorrelation, 0..1.

    A pixel and its mirror image share a folded coordinate. Grouping by it gives
    the product of the pair from sums ((a + b)^2 - a^2 - b^2 = 2ab), in integers,
    without joining the pixel table with itself.
    """
    g = pixels.select(*KEY, "y", "x", grey().alias("v"))
    stats = g.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("_s"),
        F.sum(F.col("v") * F.col("v")).alias("_q"),
        F.max("x").alias("_mx"),
        F.max("y").alias("_my"),
    )
    sized = split_join(
        g, stats.select(*KEY, "_mx", "_my"), KEY, ["y", "x"], counts=stats.select(*KEY, "n")
    )

    def mirrored(fold: Column, line: str, name: str) -> DataFrame:
        pairs = sized.groupBy(*KEY, line, fold.alias("_f")).agg(
            F.sum("v").alias("_a"),
            F.sum(F.col("v") * F.col("v")).alias("_b"),
            F.count(F.lit(1)).alias("_c"),
        )
        product = F.when(F.col("_c") == 2, F.col("_a") * F.col("_a") - F.col("_b")).otherwise(
            F.col("_b")
        )
        return pairs.groupBy(*KEY).agg(F.sum(product).alias(name))

    across = mirrored(F.least(F.col("x"), F.col("_mx") - F.col("x")), "y", "_h")
    down = mirrored(F.least(F.col("y"), F.col("_my") - F.col("y")), "x", "_v")
    base = F.col("_s").cast("double") * F.col("_s") / F.col("n")
    energy = F.col("_q") - base
    value = ((F.col("_h") - base) / energy + (F.col("_v") - base) / energy) / 2.0
    return (
        stats.join(across, KEY)
        .join(down, KEY)
        .select(
            *KEY,
            F.when(energy <= 0, F.lit(1.0)).otherwise(clip(value, 0, 1)).alias("layout_symmetry"),
        )
    )


def chromatic_coherence(pixels: DataFrame) -> DataFrame:
    """Mean of four capped terms: luminance, colourfulness, hue and saturation."""
    b, g, r = (F.col(c).cast("double") for c in "bgr")
    hue, sat = hue_sat()
    angle = F.radians(hue * 2.0)
    rg, yb = r - g, 0.5 * (r + g) - b
    s = pixels.groupBy(*KEY).agg(
        F.stddev_pop(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b).alias("_l"),
        F.stddev_pop(rg).alias("_drg"),
        F.stddev_pop(yb).alias("_dyb"),
        F.avg(rg).alias("_mrg"),
        F.avg(yb).alias("_myb"),
        F.avg(F.sin(angle)).alias("_sin"),
        F.avg(F.cos(angle)).alias("_cos"),
        F.stddev_pop(sat / 255.0).alias("_sat"),
    )
    color = F.sqrt(F.pow("_drg", F.lit(2)) + F.pow("_dyb", F.lit(2))) + 0.3 * F.sqrt(
        F.pow("_mrg", F.lit(2)) + F.pow("_myb", F.lit(2))
    )
    length = F.least(F.sqrt(F.pow("_sin", F.lit(2)) + F.pow("_cos", F.lit(2))), F.lit(1.0))
    hue_std = F.sqrt(-2.0 * F.ln(F.greatest(length, F.lit(1e-10))))
    one = F.lit(1.0)
    total = (
        F.least(F.col("_l") / LIMIT_LUM, one)
        + F.least(color / LIMIT_COLOR, one)
        + F.least(hue_std / LIMIT_HUE, one)
        + F.least(F.col("_sat") / LIMIT_SAT, one)
    )
    return s.select(*KEY, (total / 4.0).alias("chromatic_coherence"))


def linear_channel(c: str) -> Column:
    v = F.col(c) / 255.0
    return F.when(v <= SRGB_KNEE, v / SRGB_SLOPE).otherwise(
        F.pow((v + SRGB_SHIFT) / SRGB_SCALE, F.lit(SRGB_POWER))
    )


def relative_luminance() -> Column:
    return LUMA[0] * linear_channel("r") + LUMA[1] * linear_channel("g") + LUMA[2] * linear_channel("b")


def otsu_threshold(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold per group of an intensity histogram (keys, level 0..255, n).

    Largest between-class variance, lowest level on ties; dark is <= threshold.
    A group has at most 256 rows here.
    """
    w = Window.partitionBy(*keys)
    upto = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    weighted = F.col("level").cast("bigint") * F.col("n")
    h = hist.select(
        *keys,
        "level",
        F.sum("n").over(upto).alias("_n1"),
        F.sum(weighted).over(upto).alias("_s1"),
        F.sum("n").over(w).alias("_n"),
        F.sum(weighted).over(w).alias("_s"),
    )
    n1, n2 = F.col("_n1").cast("double"), (F.col("_n") - F.col("_n1")).cast("double")
    gap = F.col("_s1") / n1 - (F.col("_s") - F.col("_s1")) / F.when(n2 > 0, n2)
    sigma = F.when(n2 > 0, n1 * n2 * gap * gap)
    best = F.max(F.struct(sigma.alias("s"), (-F.col("level")).alias("l")))
    return h.filter(F.col("_n1") < F.col("_n")).groupBy(*keys).agg((-best["l"]).alias("threshold"))


def contrast_ratio(pixels: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Contrast between the lighter and darker part of each region, 2 decimals."""
    keys = list(keys)
    lum = pixels.withColumn("_lum", relative_luminance())
    level = F.floor(F.least(F.greatest(F.col("_lum") * 255.0, F.lit(0.0)), F.lit(255.0)))
    # The split only separates whole histogram levels, so the level histogram
    # with luminance sums is all that is shuffled.
    hist = lum.groupBy(*keys, level.cast("int").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_lum").alias("_sum")
    )
    cut = otsu_threshold(hist, keys)
    split = hist.join(cut, keys, "left")
    dark = F.col("level") <= F.col("threshold")
    s = split.groupBy(*keys).agg(
        F.sum(F.when(dark, F.col("_sum"))).alias("_sd"),
        F.sum(F.when(dark, F.col("n"))).alias("_nd"),
        F.sum(F.when(~dark, F.col("_sum"))).alias("_sl"),
        F.sum(F.when(~dark, F.col("n"))).alias("_nl"),
    )
    ratio = (F.col("_sl") / F.col("_nl") + 0.05) / (F.col("_sd") / F.col("_nd") + 0.05)
    return s.select(*keys, F.coalesce(F.round(ratio, 2), F.lit(1.0)).alias("contrast_ratio"))


def visual_vector(pixels: DataFrame) -> DataFrame:
    """The pixel features of every image in one table."""
    return (
        shannon_entropy(pixels)
        .join(layout_symmetry(pixels), KEY)
        .join(chromatic_coherence(pixels), KEY)
    )


def feature_range(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: min, max and mean over a batch."""
    long = features.unpivot([], list(columns), "feature", "value")
    return long.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def band_entropy(coefficients: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Entropy (nats) of a coefficient band with ceil(sqrt(n)) bins.

    The largest value has a bin of its own; one sample, one bin or a constant
    band give zero.
    """
    keys = list(keys)
    # Equal coefficients (runs of zeros above all) shrink to one row first.
    values = coefficients.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    stats = values.groupBy(*keys).agg(
        F.sum("_w").alias("_n"),
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    rows = split_join(
        values, stats.drop("n"), keys, [value], counts=stats.select(*keys, "n")
    )
    bins = F.ceil(F.sqrt("_n"))
    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, F.floor((F.col(value) - F.col("_lo")) * (bins - 1) / width)).otherwise(
        F.lit(0)
    )
    hist = rows.groupBy(*keys, place.alias("_bin")).agg(F.sum("_w").alias("_c"))
    per = hist.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.ln(F.col("_c").cast("double"))).alias("_s")
    )
    value_ = F.ln(F.col("_n").cast("double")) - F.col("_s") / F.col("_n")
    return per.select(*keys, F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(value_).alias("entropy"))


def subband_entropy(coefficients: DataFrame) -> DataFrame:
    """Weighted mean band entropy over channels l, a, b (near-flat chroma is 0).

    ``coefficients``: (image_id, channel, band, value) and the channel's own
    value range in ``channel_range``.
    """
    keys = [*KEY, "channel", "band"]
    bands = band_entropy(coefficients, keys)
    ranges = coefficients.groupBy(*KEY, "channel").agg(F.max("channel_range").alias("_r"))
    flat = (F.col("channel") != "l") & (F.col("_r") < CHROMA_FLAT)
    per = bands.join(ranges, [*KEY, "channel"]).groupBy(*KEY, "channel").agg(
        F.avg(F.when(flat, F.lit(0.0)).otherwise(F.col("entropy"))).alias("_e")
    )
    weight = F.when(F.col("channel") == "l", F.lit(1.0)).otherwise(F.lit(CHROMA_WEIGHT))
    return per.groupBy(*KEY).agg(
        (F.sum(weight * F.col("_e")) / (1 + 2 * CHROMA_WEIGHT)).alias("subband_entropy")
    )


def element_density(regions: DataFrame) -> DataFrame:
    """Interactive-looking regions per 10 000 pixels (region_area, w, h, img_area)."""
    area, whole = F.col("region_area"), F.col("img_area")
    aspect = F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1))
    solid = area / F.greatest(F.col("w") * F.col("h"), F.lit(1))
    fits = (
        (area > whole * ELEMENT_MIN)
        & (area < whole * ELEMENT_MAX)
        & (aspect < ELEMENT_ASPECT)
        & (solid > ELEMENT_SOLIDITY)
    )
    return regions.groupBy("screen_id").agg(
        (F.count_if(fits) / (F.max("img_area") / 10000.0)).alias("interactive_element_density")
    )


def visual_hierarchy(edge_counts: DataFrame, components: DataFrame) -> DataFrame:
    """Mean of weighted edge survival over seven levels and the top-3 area share.

    ``edge_counts``: (screen_id, level 0..6, edges); ``components``: (screen_id,
    component_id, component_area, img_area).
    """
    per = edge_counts.groupBy("screen_id").agg(
        *[F.max(F.when(F.col("level") == k, F.col("edges"))).alias(f"_e{k}") for k in range(7)]
    )
    spread = F.col("_e0") - F.col("_e6")
    steps = sum(
        ((F.col(f"_e{k}") - F.col(f"_e{k + 1}")) * (k / 6.0) for k in range(1, 6)), F.lit(0.0)
    )
    contrast = F.when(spread > 0, steps / spread).otherwise((F.col("_e6") > 0).cast("double"))
    w = Window.partitionBy("screen_id").orderBy(F.desc("component_area"), "component_id")
    top = (
        components.withColumn("_k", F.row_number().over(w))
        .filter(F.col("_k") <= 3)
        .groupBy("screen_id")
        .agg((F.sum("component_area") / F.max("img_area")).alias("_top"))
    )
    return per.join(top, "screen_id", "left").select(
        "screen_id",
        ((clip(contrast, 0, 1) + clip(F.coalesce("_top", F.lit(1.0)), 0, 1)) / 2.0).alias(
            "visual_hierarchy"
        ),
    )
