"""Saliency and fixation maps as long tables (map_id, y, x, value …).

Per-map statistics come from plain aggregates, which combine before the
shuffle; where a second pass needs them, they are joined back with
``split_join`` so that one giant map is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocuspark.operators import ranks
from ocuspark.operators.skew import split_join

KEY = ["map_id"]
CELL = ["y", "x"]
# Fixed values of the map statistics.
FLAT, PROB_EPS, TRAIN_EPS = 1e-12, 1e-8, 1e-10
MINMAX_EPS = 1e-8
SALIENCY_BINS, DISPERSION_UNIT, CENTER_LOW, CENTER_HIGH, COVER_SHARE = 32, 0.707, 0.25, 0.75, 0.5
WEIGHT_KL, WEIGHT_CC = 10.0, -3.0


def _with_stats(df: DataFrame, aggs: list[Column]) -> DataFrame:
    stats = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return split_join(df, stats, KEY, CELL, counts=stats.select(*KEY, "n"))


def scale_and_binarise(df: DataFrame, label: str = "gt", fixation: str = "fix") -> DataFrame:
    """Label maps above 1 are divided by 255; fixation maps become > 0.5."""
    rows = _with_stats(df, [F.max(label).alias("_max")])
    value = F.when(F.col("_max") > 1.0, F.col(label) / 255.0).otherwise(F.col(label))
    return rows.withColumns(
        {label: value, fixation: F.when(F.col(fixation) > 0.5, 1.0).otherwise(0.0)}
    ).drop("n", "_max")


def normalise(df: DataFrame, value: str = "pred") -> DataFrame:
    """Min-max, sum-to-one and max normalisation of every map."""
    v = F.col(value)
    rows = _with_stats(
        df, [F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sum(v).alias("_sum")]
    )
    width = F.col("_hi") - F.col("_lo")
    return rows.withColumns(
        {
            "minmax": F.when(width < FLAT, F.lit(0.0)).otherwise((v - F.col("_lo")) / width),
            "prob": F.when(F.col("_sum") < FLAT, 1.0 / F.col("n")).otherwise(v / F.col("_sum")),
            "maxed": F.when(F.col("_hi") > 0, v / F.col("_hi")).otherwise(v),
        }
    ).drop("n", "_lo", "_hi", "_sum")


def saliency_features(df: DataFrame, value: str = "pred") -> DataFrame:
    """Per map: dispersion, centre bias, entropy and coverage.

    One pass gives size, maximum and spatial moments; a second one, with these
    attached, fills the histogram together with the centre and coverage sums.
    """
    v, x, y = F.col(value), F.col("x").cast("double"), F.col("y").cast("double")
    stats = df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("x") + 1).alias("w"),
        (F.max("y") + 1).alias("h"),
        F.max(v).alias("vmax"),
        F.sum(v).alias("total"),
        F.sum(v * x).alias("_x"),
        F.sum(v * y).alias("_y"),
        F.sum(v * x * x).alias("_xx"),
        F.sum(v * y * y).alias("_yy"),
    )
    small = stats.select(*KEY, "w", "h", "vmax")
    rows = split_join(df, small, KEY, CELL, counts=stats.select(*KEY, "n"))
    scaled = F.when(F.col("vmax") > 0, v / F.col("vmax")).otherwise(v)
    bin_ = F.least(F.floor(scaled * SALIENCY_BINS), F.lit(SALIENCY_BINS - 1))
    inner = lambda c, size: (F.col(c) >= F.floor(F.col(size) * CENTER_LOW)) & (
        F.col(c) < F.floor(F.col(size) * CENTER_HIGH)
    )
    binned = rows.groupBy(*KEY, bin_.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum(F.when(inner("x", "w") & inner("y", "h"), v).otherwise(0.0)).alias("_in"),
        F.count_if(scaled > COVER_SHARE).alias("_above"),
    )
    second = binned.groupBy(*KEY).agg(
        F.sum("_c").alias("_cells"),
        F.sum(F.col("_c") * F.log2(F.col("_c").cast("double"))).alias("_clog"),
        F.sum("_in").alias("_in"),
        F.sum("_above").alias("_above"),
    )
    t = F.col("total")

    def variance(m1: str, m2: str, size: str) -> Column:
        unit = F.greatest(F.col(size) - 1, F.lit(1)).cast("double")
        return F.greatest(F.col(m2) / t - F.pow(F.col(m1) / t, 2), F.lit(0.0)) / (unit * unit)

    sigma = F.sqrt(variance("_x", "_xx", "w") + variance("_y", "_yy", "h"))
    entropy = (F.log2(F.col("_cells").cast("double")) - F.col("_clog") / F.col("_cells")) / math.log2(
        SALIENCY_BINS
    )
    return stats.join(second, KEY).select(
        *KEY,
        F.when(t == 0, F.lit(0.0))
        .otherwise(F.least(sigma / DISPERSION_UNIT, F.lit(1.0)))
        .alias("saliency_dispersion"),
        F.when(t == 0, F.lit(0.0)).otherwise(F.col("_in") / t).alias("saliency_center_bias"),
        entropy.alias("saliency_entropy"),
        F.when(F.col("vmax") == 0, F.lit(0.0))
        .otherwise(F.col("_above") / F.col("n"))
        .alias("saliency_coverage"),
    )


def _moments(p: str, g: str) -> list[Column]:
    fixated = F.col(g) > 0
    return [
        F.sum(p).alias("sp"),
        F.sum(g).alias("sg"),
        F.min(p).alias("p_lo"),
        F.max(p).alias("p_hi"),
        F.min(g).alias("g_lo"),
        F.max(g).alias("g_hi"),
        F.avg(p).alias("mp"),
        F.stddev_pop(p).alias("dp"),
        F.stddev_pop(g).alias("dg"),
        F.covar_pop(p, g).alias("cov"),
        F.avg(F.when(fixated, F.col(p))).alias("fix_mean"),
    ]


def agreement(df: DataFrame, pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Per map pair: NSS, CC, SIM and KL(gt || pred).

    NSS and CC follow from one pass of moments; SIM and KL need the map sums and
    take a second pass.
    """
    stats = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *_moments(pred, gt))
    rows = split_join(
        df, stats.select(*KEY, F.col("n").alias("cells"), "sp", "sg"), KEY, CELL,
        counts=stats.select(*KEY, "n"),
    )

    def share(value: str, total: str) -> Column:
        return F.when(F.col(total) < FLAT, 1.0 / F.col("cells")).otherwise(
            F.col(value) / F.col(total)
        )

    p, g = share(pred, "sp"), share(gt, "sg")
    scale = 1.0 + F.col("cells") * PROB_EPS
    q, r = (p + PROB_EPS) / scale, (g + PROB_EPS) / scale
    second = rows.groupBy(*KEY).agg(
        F.sum(F.least(p, g)).alias("sim"), F.sum(r * F.ln(r / q)).alias("kl")
    )
    flat = (F.col("dp") < FLAT) | (F.col("dg") < FLAT)
    nss = F.when((F.col("dp") < FLAT) | F.col("fix_mean").isNull(), F.lit(0.0)).otherwise(
        (F.col("fix_mean") - F.col("mp")) / F.col("dp")
    )
    cc = F.when(flat, F.lit(0.0)).otherwise(F.col("cov") / (F.col("dp") * F.col("dg")))
    return stats.join(second, KEY).select(*KEY, nss.alias("nss"), cc.alias("cc"), "sim", "kl")


def training_agreement(df: DataFrame, pred: str = "pred", gt: str = "gt", fix: str = "fix") -> DataFrame:
    """The training-time variants: epsilon 1e-10 KL, min-max SIM, sample-std NSS."""
    stats = df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *_moments(pred, gt),
        F.stddev_samp(pred).alias("ds"),
        F.sum(F.greatest(F.col(pred), F.lit(0.0))).alias("sp0"),
        F.sum(fix).alias("sf"),
        F.sum(F.col(fix) * F.col(pred)).alias("sfp"),
    )
    names = ["sp0", "sg", "p_lo", "p_hi", "g_lo", "g_hi", "sp"]
    rows = split_join(
        df, stats.select(*KEY, F.col("n").alias("cells"), *names), KEY, CELL,
        counts=stats.select(*KEY, "n"),
    )
    p = F.greatest(F.col(pred), F.lit(0.0)) / (F.col("sp0") + TRAIN_EPS)
    g = F.col(gt) / (F.col("sg") + TRAIN_EPS)

    def minmax_share(value: str, total: str, lo: str, hi: str) -> Column:
        width = F.col(hi) - F.col(lo) + MINMAX_EPS
        whole = (F.col(total) - F.col("cells") * F.col(lo)) / width + MINMAX_EPS
        return (F.col(value) - F.col(lo)) / width / whole

    second = rows.groupBy(*KEY).agg(
        F.sum(g * F.ln((g + TRAIN_EPS) / (p + TRAIN_EPS))).alias("kl"),
        F.sum(
            F.least(minmax_share(pred, "sp", "p_lo", "p_hi"), minmax_share(gt, "sg", "g_lo", "g_hi"))
        ).alias("sim"),
    )
    std = F.when(F.col("ds") < MINMAX_EPS, F.lit(1.0)).otherwise(F.col("ds"))
    nss = F.when(F.col("sf") == 0, F.lit(0.0)).otherwise(
        (F.col("sfp") - F.col("mp") * F.col("sf")) / std / F.greatest("sf", F.lit(MINMAX_EPS))
    )
    cc = F.when((F.col("dp") == 0) | (F.col("dg") == 0), F.lit(0.0)).otherwise(
        F.col("cov") / (F.col("dp") * F.col("dg"))
    )
    return stats.join(second, KEY).select(*KEY, nss.alias("nss"), cc.alias("cc"), "sim", "kl")


def composite_agreement(metrics: DataFrame, nss_weight: float = 0.0, sim_weight: float = 0.0):
    return metrics.withColumn(
        "composite",
        WEIGHT_KL * F.col("kl")
        + WEIGHT_CC * F.col("cc")
        + nss_weight * F.col("nss")
        + sim_weight * F.col("sim"),
    )


def auc_judd(df: DataFrame, pred: str = "pred", fix: str = "gt") -> DataFrame:
    """Per map: area under the ROC of saliency at fixated pixels.

    With thresholds at the fixations in falling order the trapezoid sum
    telescopes: it only needs, for every fixated value, the number of pixels at
    or above it. These counts come from the distributed ranking, so neither a
    large map nor a large patch of equal values lands in one task. Flat maps and
    maps without fixations have no value (null).
    """
    hit = (F.col(fix) > 0).cast("bigint")
    ranked = ranks.cumulative(df, KEY, pred, {"c": F.lit(1), "f": hit})
    above = F.col("c_total") - F.col("c_before")
    per = ranked.groupBy(*KEY).agg(
        F.max("c_total").alias("_p"),
        F.max("f_total").alias("_f"),
        F.sum(F.col("f") * above).alias("_sum"),
        F.max(F.when(F.col("f") > 0, above)).alias("_last"),
        F.count(F.lit(1)).alias("_values"),
    )
    fcount, rest = F.col("_f"), F.col("_p") - F.col("_f")
    fp_sum = (F.col("_sum") - fcount * (fcount - 1) / 2) / rest
    fp_last = (F.col("_last") - (fcount - 1)) / rest
    usable = (fcount > 0) & (rest > 0) & (F.col("_values") > 1)
    return per.select(*KEY, F.when(usable, 1.0 - (fp_sum - fp_last / 2) / fcount).alias("auc"))


def shuffled_auc(df: DataFrame, pred: str = "pred", fix: str = "gt") -> DataFrame:
    """Per map: chance that a fixated pixel outranks a fixation of another map.

    Instead of random draws, every fixation of the other maps counts at its
    place, so the result is the exact expectation. Places fixated anywhere form
    a table of at most one row per pixel position.
    """
    own = (F.col(fix) > 0).cast("bigint")
    places = df.groupBy(*CELL).agg(F.sum(own).alias("_all"))
    # Few positions, any number of maps: the map spreads a position over tasks.
    rows = split_join(df, places, CELL, KEY).withColumns({"_pos": own, "_neg": F.col("_all") - own})
    ranked = ranks.cumulative(rows, KEY, pred, {"pos": F.col("_pos"), "neg": F.col("_neg")})
    per = ranked.groupBy(*KEY).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("_wins"),
        F.max("pos_total").alias("_p"),
        F.max("neg_total").alias("_n"),
    )
    usable = (F.col("_p") > 0) & (F.col("_n") > 0)
    return per.select(
        *KEY, F.when(usable, F.col("_wins") / (F.col("_p") * F.col("_n"))).alias("shuffled_auc")
    )


def validation_report(df: DataFrame, pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Per map: NSS, CC, SIM, KL and AUC."""
    return agreement(df, pred, gt).join(auc_judd(df, pred, gt), KEY)


def edge_density(df: DataFrame, edge: str = "edge") -> DataFrame:
    return df.groupBy(*KEY).agg(F.avg(F.col(edge).cast("double")).alias("edge_density"))
