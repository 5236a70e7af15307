"""Trial-table analytics: cleaning, condition means, ratios and paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocuspark.functions.columns import clip
from ocuspark.operators import ranks
from ocuspark.operators.lineage import cut
from ocuspark.operators.skew import split_join

# Trial metrics, condition levels and published effect ratios.
METRICS = ["total_num_fixations", "mean_fixation_duration", "fixation_frequency"]
CLEANED = ["total_num_fixations", "mean_fixation_duration", "total_fixation_duration"]
LEVELS = ["Absent", "High", "Low"]
EXPECTED_FIXATION_RATIO, EXPECTED_DURATION_RATIO = 0.876, 1.082
WITHIN = 0.05


def clean_trials(df: DataFrame, columns=CLEANED) -> DataFrame:
    """Non-numeric and negative (sentinel) metric values become null."""
    numeric = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns({c: F.when(n >= 0, n) for c, n in numeric.items()})


def baseline(df: DataFrame, load: str = "Absent", highlight: str | None = "Absent") -> DataFrame:
    out = df.filter(F.col("cognitive_load") == load)
    return out if highlight is None else out.filter(F.col("highlight") == highlight)


def means_by(df: DataFrame, keys: list[str], columns=METRICS) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def image_condition_means(clean: DataFrame) -> DataFrame:
    """Per image and load: mean count, duration, total duration and valid count."""
    return clean.groupBy("image_name", "cognitive_load").agg(
        F.avg("total_num_fixations").alias("mean_fixation_count"),
        F.avg("mean_fixation_duration").alias("mean_fixation_duration"),
        F.avg("total_fixation_duration").alias("mean_total_duration"),
        F.count("total_num_fixations").alias("n_obs"),
    )


def interaction_means(df: DataFrame, margins: bool = False) -> DataFrame:
    """Highlight x load means; ``margins`` adds the subtotals of a cube."""
    grouped = (df.cube if margins else df.groupBy)("highlight", "cognitive_load")
    return grouped.agg(*[F.avg(c).alias(c) for c in METRICS])


def hit_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("cognitive_load", "highlight").agg(F.avg("aoi_hit").alias("aoi_hit_rate"))


def pivot_loads(image_means: DataFrame, value: str) -> DataFrame:
    """One row per image, one column per load level (levels are fixed)."""
    wide = image_means.groupBy("image_name").pivot("cognitive_load", LEVELS).agg(F.avg(value))
    return wide.select("image_name", *[F.col(v).alias(v.lower()) for v in LEVELS])


def sensitivity_ratio(wide: DataFrame) -> DataFrame:
    """High / Absent per image (a zero baseline gives no ratio)."""
    ratio = F.when(F.col("absent") != 0, F.col("high") / F.col("absent"))
    return wide.withColumn("sensitivity_high", ratio)


def describe(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, exact quartiles, max (one row per group)."""
    groups = groups or []
    stats = df.groupBy(*groups).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quartiles = ranks.exact_quantiles(df, groups, column, [0.25, 0.5, 0.75])
    if groups:
        return stats.join(quartiles, groups, "left")
    row = quartiles.select(F.struct("*")).scalar()
    names = ["p25", "p50", "p75"]
    with_row = stats.withColumn("_q", row)
    return with_row.select("*", *[F.col(f"_q.{n}").alias(n) for n in names]).drop("_q")


def sensitivity_lookup(trials: DataFrame, baseline_means: dict[str, str] | None = None) -> DataFrame:
    """Per image: load ratios, highlight effectiveness and combined load index.

    Condition means come from one grouping with conditional averages, so no
    self-joins are needed. Images without baseline or high-load rows drop out.
    ``baseline_means`` (name: column) adds further means over the baseline rows
    in the same grouping.
    """
    more = baseline_means or {}

    def mean_if(load: str, highlight: str, c: str) -> Column:
        here = (F.col("cognitive_load") == load) & (F.col("highlight") == highlight)
        return F.avg(F.when(here, F.col(c)))

    def rows_if(load: str, highlight: str) -> Column:
        return F.count_if((F.col("cognitive_load") == load) & (F.col("highlight") == highlight))

    fix, dur, freq = METRICS
    wide = trials.groupBy("image_name").agg(
        *[mean_if("Absent", "Absent", c).alias(f"_b{i}") for i, c in enumerate((fix, dur, freq))],
        *[mean_if("High", "Absent", c).alias(f"_h{i}") for i, c in enumerate((fix, dur, freq))],
        mean_if("High", "Dynamic", fix).alias("_d0"),
        rows_if("Absent", "Absent").alias("_nb"),
        rows_if("High", "Absent").alias("_nh"),
        rows_if("High", "Dynamic").alias("_nd"),
        *[mean_if("Absent", "Absent", c).alias(name) for name, c in more.items()],
    )
    wide = wide.filter((F.col("_nb") > 0) & (F.col("_nh") > 0))
    ratio = [
        F.when(F.col(f"_b{i}") > 0, F.col(f"_h{i}") / F.col(f"_b{i}")).otherwise(F.lit(1.0))
        for i in range(3)
    ]
    highlight = F.when(F.col("_nd") == 0, F.lit(0.7)).otherwise(
        F.when(F.col("_b0") > 0, F.col("_d0") / F.col("_b0")).otherwise(F.lit(0.5))
    )
    out = wide.select(
        "image_name",
        ratio[0].alias("fixation_reduction"),
        ratio[1].alias("duration_increase"),
        ratio[2].alias("exploration_reduction"),
        F.lit(0.4).alias("aoi_sensitivity"),
        highlight.alias("highlight_effectiveness"),
        *more,
    )
    index = (
        0.30 * (1.0 - F.col("fixation_reduction"))
        + 0.20 * F.greatest(F.lit(0.0), F.col("duration_increase") - 1.0)
        + 0.20 * (1.0 - F.col("exploration_reduction"))
        + 0.15 * F.col("aoi_sensitivity")
        + 0.15 * (1.0 - F.col("highlight_effectiveness"))
    ) / 0.3
    return out.withColumn("cognitive_load_index", clip(index, 0.0, 1.0))


def images_with_both(trials: DataFrame) -> DataFrame:
    """Trials of images that have baseline and high-load rows."""
    counts = cut(both_conditions(trials))
    both = counts.filter(F.col("both") & F.col("image_name").isNotNull()).select("image_name")
    return split_join(trials, both, ["image_name"], how="left_semi", counts=counts.select("image_name", "n"), look=True)


def both_conditions(trials: DataFrame) -> DataFrame:
    """Per image: n trials, and whether there are both baseline and high-load rows; one pass."""
    plain = F.col("highlight") == "Absent"
    some = lambda load: F.count_if(plain & (F.col("cognitive_load") == load)) > 0
    return trials.groupBy("image_name").agg(F.count(F.lit(1)).alias("n"), (some("Absent") & some("High")).alias("both"))


def paired(image_means: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Rows (image, a, b) for the images that have both conditions."""
    pick = lambda level: F.max(F.when(F.col("cognitive_load") == level, F.col(metric)))
    return (
        image_means.filter(F.col("cognitive_load").isin(first, second))
        .groupBy("image_name")
        .agg(
            pick(first).alias("a"), pick(second).alias("b"), F.count(F.lit(1)).alias("_levels")
        )
        .filter(F.col("_levels") == 2)
        .drop("_levels")
    )


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, F.lit("negligible"))
        .when(size < 0.5, F.lit("small"))
        .when(size < 0.8, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def paired_test(pairs: DataFrame) -> DataFrame:
    """One row: n, means, ratio, paired t, Cohen's d (pooled std) and its label."""
    diff = F.col("a") - F.col("b")
    s = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(diff).alias("_md"),
        F.stddev_samp(diff).alias("_sd"),
        F.var_samp("a").alias("_va"),
        F.var_samp("b").alias("_vb"),
    )
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    d = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(pooled == 0, F.lit(0.0))
        .otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)
    )
    t = F.when(F.col("_sd") > 0, F.col("_md") / (F.col("_sd") / F.sqrt("n")))
    ratio = F.when(F.col("mean_a") != 0, F.col("mean_b") / F.col("mean_a"))
    return s.select(
        "n",
        (F.col("n") - 1).alias("df"),
        "mean_a",
        "mean_b",
        ratio.alias("ratio"),
        t.alias("t_statistic"),
        d.alias("cohens_d"),
        effect_label(d).alias("effect_size"),
    )


def student_t_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t (incomplete beta by continued fraction)."""
    if df < 1 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x >= (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function; NaN if it does not settle."""
    tiny, steps = 1e-300, 300 + int(10 * math.sqrt(max(a, b)))
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, steps):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            return h
    return float("nan")


@F.udf(T.DoubleType())
def _p_value(t, df):
    return None if t is None else student_t_p(t, int(df))


def hypothesis_report(image_means: DataFrame) -> DataFrame:
    """The two study hypotheses, one row each (p is computed on these rows only)."""
    rows = None
    for name, metric, direction in (
        ("H1", "mean_fixation_count", "decrease"),
        ("H2", "mean_fixation_duration", "increase"),
    ):
        main = paired_test(paired(image_means, metric, "Absent", "High"))
        low = paired_test(paired(image_means, metric, "Low", "High"))
        row = main.withColumn("_low", low.select(F.struct("t_statistic", "df")).scalar()).select(
            F.lit(name).alias("hypothesis"),
            F.lit(metric).alias("metric"),
            F.lit(direction).alias("direction"),
            F.col("n").alias("n_images"),
            F.col("mean_a").alias("mean_absent"),
            F.col("mean_b").alias("mean_high"),
            F.col("ratio").alias("ratio_high_absent"),
            "t_statistic",
            "df",
            "cohens_d",
            "effect_size",
            F.col("_low.t_statistic").alias("t_low_vs_high"),
            F.col("_low.df").alias("_df_low"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return (
        rows.withColumn("p_value", _p_value("t_statistic", "df"))
        .withColumn("p_value_low_vs_high", _p_value("t_low_vs_high", "_df_low"))
        .withColumn("significant", F.col("p_value") < 0.05)
        .drop("_df_low")
    )


def compare_with_expected(report: DataFrame) -> DataFrame:
    """Observed ratios next to the published ones, with a five-percent flag."""
    expected = F.when(F.col("hypothesis") == "H1", F.lit(EXPECTED_FIXATION_RATIO)).otherwise(
        F.lit(EXPECTED_DURATION_RATIO)
    )
    deviation = F.abs(F.col("ratio_high_absent") - expected)
    return report.select(
        "hypothesis",
        F.col("ratio_high_absent").alias("observed"),
        expected.alias("expected"),
        deviation.alias("deviation"),
        (deviation < WITHIN).alias("within_5pct"),
    )


def load_effect(image_means: DataFrame) -> DataFrame:
    """Per image: (High - Absent) / Absent fixation count."""
    return paired(image_means, "mean_fixation_count", "Absent", "High").select(
        "image_name", ((F.col("b") - F.col("a")) / F.col("a")).alias("cl_effect")
    )


GRAM = 3


def _grams(df: DataFrame, text: str, sizes: Column) -> DataFrame:
    """text and _gram: its distinct runs of the given numbers of characters."""
    cuts = F.transform(
        sizes,
        lambda k: F.when(
            k <= F.length(text),
            F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(F.col(text), i, k)),
        ).otherwise(F.array().cast("array<string>")),
    )
    return df.select(text, F.explode(F.array_distinct(F.flatten(cuts))).alias("_gram"))


def contained(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """(short, long) for every distinct text of ``shorts`` that a text of ``longs`` contains; empty texts match nothing.

    An index of runs of GRAM characters: each short text looks up only its run
    that the fewest long texts hold (texts shorter than a run are a run
    themselves), and what it finds is compared whole. Rows are linear in text
    length; a run with a large share of the long texts is split.
    """
    s = shorts.select(F.col(shorts.columns[0]).alias("short")).filter(F.length("short") > 0).distinct()
    n = longs.select(F.col(longs.columns[0]).alias("long")).filter(F.length("long") > 0).distinct()
    index = _grams(n, "long", F.array(*[F.lit(k) for k in range(1, GRAM + 1)]))
    held = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("n"))
    own = split_join(_grams(s, "short", F.array(F.least(F.lit(GRAM), F.length("short")))), held, ["_gram"], how="left")
    rarest = own.groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_gram"))).alias("seed"))
    seeds = rarest.filter("seed.n > 0").select("short", F.col("seed._gram").alias("_gram"))
    met = split_join(index, seeds, ["_gram"], counts=held)
    return met.filter(F.contains("long", "short")).select("short", "long")


def fuzzy_match(stems: DataFrame, names: DataFrame) -> DataFrame:
    """First name (by order) that contains the stem or is contained in it."""
    s, n = stems.select("stem"), names.select("name")
    in_name = contained(s, n).select(F.col("short").alias("stem"), F.col("long").alias("name"))
    in_stem = contained(n, s).select(F.col("long").alias("stem"), F.col("short").alias("name"))
    return in_name.unionByName(in_stem).groupBy("stem").agg(F.min("name").alias("name"))
