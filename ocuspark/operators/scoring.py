"""Rule scoring of feature tables.

Everything here is a projection (plus joins with tables of a handful of rows),
so a scored corpus costs one scan and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocuspark.functions.columns import clip, lookup
from ocuspark.functions.reference_norms import REFERENCE_NORMS
from ocuspark.operators.norms import SALIENCY, VISUAL, norms_table, to_long

# ---- Fixed values -------------------------------------------------------
EFFECTS = {
    "fixation_reduction": 0.876,
    "duration_increase": 1.081,
    "frequency_reduction": 0.935,
    "aoi_hit_baseline": 0.115,
    "aoi_hit_loaded": 0.069,
}
CONCEPTS = {
    "edge_density": "edge_density",
    "layout_complexity": "feature_congestion",
    "element_count": "interactive_element_density",
    "symmetry": "layout_symmetry",
    "grid_quality": "visual_hierarchy",
}
TASK_TYPE = {
    "navigation": 0.45,
    "search": 0.65,
    "monitoring": 0.55,
    "data_entry": 0.70,
    "decision": 0.80,
}
SPECIFICITY = {"high": 0.25, "medium": 0.55, "low": 0.85}
TIME_PRESSURE = {"low": 0.20, "medium": 0.55, "high": 0.90}
SEARCH_MODE = {"known_item": 0.30, "comparative": 0.70, "exploratory": 0.90}
# openness, conscientiousness, agreeableness, extraversion, neuroticism
PROFILES = {
    "neutral": [0.50, 0.50, 0.50, 0.50, 0.50],
    "focused": [0.40, 0.82, 0.35, 0.55, 0.25],
    "exploratory": [0.72, 0.48, 0.82, 0.58, 0.32],
    "social": [0.68, 0.52, 0.60, 0.84, 0.34],
    "stress_sensitive": [0.35, 0.46, 0.42, 0.40, 0.82],
}
TRAITS = ["openness", "conscientiousness", "agreeableness", "extraversion", "neuroticism"]
DESIGN_CLASSES = ["poster", "infographic", "mobile_ui", "desktop_ui", "web_page", "natural_image"]
OUT_OF_DOMAIN = ["mobile_ui", "web_page", "poster", "infographic", "natural_image"]
SPREAD_HIGH, SPREAD_LOW = 0.55, 0.25
FIXATIONS_LOW, LOAD_HIGH, SEARCH_TIME_HIGH, LOAD_LOW = 6.0, 60.0, 4.0, 35.0
LOAD_NAMES = [
    "cog_fixation_reduction",
    "cog_duration_increase",
    "cog_exploration_reduction",
    "cog_aoi_sensitivity",
    "highlight_effectiveness",
    "cognitive_load_index",
]
TASK_NAMES = [
    "task_type_weight",
    "target_specificity_weight",
    "time_pressure_weight",
    "search_mode_weight",
    "visual_search_intensity",
    "decisional_demand",
]
# -------------------------------------------------------------------------

ANCHOR_STATS = ["min", "p5", "p25", "p50", "p75", "p95", "max"]
ANCHOR_SHARE = [0.0, 0.05, 0.25, 0.50, 0.75, 0.95, 1.0]


def empirical_percentile(value: Column, stat) -> Column:
    """0..100 between the anchors; the first matching segment decides ties."""
    xs = [stat(s) for s in ANCHOR_STATS]
    ps = [100.0 * p for p in ANCHOR_SHARE]
    out = F.when(value <= xs[0], F.lit(0.0)).when(value >= xs[-1], F.lit(100.0))
    for (x0, p0), (x1, p1) in zip(zip(xs, ps), zip(xs[1:], ps[1:])):
        inside = value.between(x0, x1)
        slope = F.when(x1 == x0, F.lit(p1)).otherwise(p0 + (p1 - p0) * (value - x0) / (x1 - x0))
        out = out.when(inside, slope)
    return out.otherwise(F.lit(50.0))


def percentile_share(value: Column, norm: dict[str, float] | None) -> Column:
    """0..1 by strictly increasing anchors; missing value or norm gives 0.5."""
    anchors: list[tuple[float, float]] = []
    for s, p in zip(ANCHOR_STATS, ANCHOR_SHARE):
        x = (norm or {}).get(s)
        if x is not None and (not anchors or x > anchors[-1][0]):
            anchors.append((float(x), p))
    if not anchors:
        return F.lit(0.5)
    out = F.when(value.isNull(), F.lit(0.5)).when(value <= anchors[0][0], F.lit(anchors[0][1]))
    for (x0, p0), (x1, p1) in zip(anchors, anchors[1:]):
        out = out.when(value <= x1, p0 + (p1 - p0) * (value - x0) / (x1 - x0))
    return out.otherwise(F.lit(anchors[-1][1]))


def band(z: Column) -> Column:
    size = F.abs(z)
    return (
        F.when(size < 1, F.lit("typical"))
        .when(size < 2, F.when(z > 0, F.lit("above_typical")).otherwise(F.lit("below_typical")))
        .when(z > 0, F.lit("far_above_typical"))
        .otherwise(F.lit("far_below_typical"))
    )


def compare_to_norms(df: DataFrame, id_cols: list[str], norms: DataFrame, features) -> DataFrame:
    """Long table: value, z, change from the mean in percent, percentile, band."""
    long = to_long(df, id_cols, features).filter(F.col("value").isNotNull())
    joined = long.join(norms.filter(F.col("std") != 0), "feature")
    z = (F.col("value") - F.col("mean")) / F.col("std")
    delta = F.when(
        F.col("mean") != 0, (F.col("value") - F.col("mean")) / F.col("mean") * 100.0
    )
    return joined.select(
        *id_cols,
        "feature",
        "value",
        z.alias("z"),
        delta.alias("delta_pct"),
        empirical_percentile(F.col("value"), F.col).alias("percentile"),
        band(z).alias("band"),
        "n",
    )


def load_features(df: DataFrame, norms: dict = REFERENCE_NORMS, saliency: bool = True) -> DataFrame:
    """Add the six load features; needs the visual (and saliency) columns."""
    concept = {
        c: percentile_share(F.col(f).cast("double"), norms.get(f)) for c, f in CONCEPTS.items()
    }
    df = df.withColumns({f"_{c}": v for c, v in concept.items()})
    edge, crowd, count = F.col("_edge_density"), F.col("_layout_complexity"), F.col("_element_count")
    space = F.coalesce(clip("whitespace_ratio", 0, 1), clip(1.0 - count, 0, 1))
    text = F.coalesce(clip("text_density", 0, 1), F.lit(0.5))
    complexity = (edge + count + crowd) / 3.0
    if saliency:
        spread = percentile_share(F.col("saliency_dispersion"), norms.get("saliency_dispersion"))
        cover = percentile_share(F.col("saliency_coverage"), norms.get("saliency_coverage"))
        absent = F.lit(True)
        for s in SALIENCY:
            absent = absent & F.col(s).isNull()
        need = F.when(absent, complexity).otherwise((spread + (1.0 - cover)) / 2.0)
    else:
        need = complexity
    df = df.withColumns({"_space": space, "_text": text, "_need": need, "_complexity": complexity})
    order = (F.col("_symmetry") + F.col("_grid_quality")) / 2.0
    drop = (EFFECTS["aoi_hit_baseline"] - EFFECTS["aoi_hit_loaded"]) / EFFECTS["aoi_hit_baseline"]
    df = df.withColumns(
        {
            LOAD_NAMES[0]: clip(
                EFFECTS["fixation_reduction"] - 0.05 * (F.col("_complexity") - F.col("_space")),
                0.6,
                1.1,
            ),
            LOAD_NAMES[1]: clip(
                EFFECTS["duration_increase"] + 0.1 * ((F.col("_text") + count) / 2.0), 0.8, 1.5
            ),
            LOAD_NAMES[2]: clip(
                EFFECTS["frequency_reduction"] - 0.04 * (1.0 - order), 0.7, 1.0
            ),
            LOAD_NAMES[3]: clip(drop * (0.7 + 0.6 * (1.0 - F.col("_space"))), 0, 1),
            LOAD_NAMES[4]: clip(0.5 + 0.4 * F.col("_need"), 0, 1),
        }
    )
    index = (
        0.30 * (1.0 - F.col(LOAD_NAMES[0]))
        + 0.20 * (F.col(LOAD_NAMES[1]) - 1.0)
        + 0.20 * (1.0 - F.col(LOAD_NAMES[2]))
        + 0.15 * F.col(LOAD_NAMES[3])
        + 0.15 * (1.0 - F.col(LOAD_NAMES[4]))
    ) / 0.3
    presence = clip(F.greatest(edge, count, crowd, 1.0 - F.col("_space")), 0, 1)
    df = df.withColumn(LOAD_NAMES[5], clip(index, 0, 1) * presence)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def lookup_or_estimate(estimated: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """Use the measured load features where the image is known."""
    names = [
        "fixation_reduction",
        "duration_increase",
        "exploration_reduction",
        "aoi_sensitivity",
        "highlight_effectiveness",
        "cognitive_load_index",
    ]
    known = measured.select(key, *[F.col(c).alias(f"_m_{c}") for c in names])
    joined = estimated.join(known, key, "left")
    found = F.col("_m_fixation_reduction").isNotNull()
    return joined.withColumns(
        {
            **{
                out: F.when(found, F.col(f"_m_{c}")).otherwise(F.col(out))
                for out, c in zip(LOAD_NAMES, names)
            },
            "source": F.when(found, F.lit("lookup")).otherwise(F.lit("estimate")),
        }
    ).drop(*[f"_m_{c}" for c in names])


def task_columns(df: DataFrame) -> DataFrame:
    """Task vector and modifier; unknown keys use the default task."""
    w = lookup("task_type", TASK_TYPE, TASK_TYPE["search"])
    spec = lookup("target_specificity", SPECIFICITY, SPECIFICITY["medium"])
    press = lookup("time_pressure", TIME_PRESSURE, TIME_PRESSURE["medium"])
    mode = lookup("search_mode", SEARCH_MODE, SEARCH_MODE["known_item"])
    df = df.withColumns(dict(zip(TASK_NAMES[:4], (w, spec, press, mode))))
    a, b, c, d = (F.col(n) for n in TASK_NAMES[:4])
    return df.withColumns(
        {
            TASK_NAMES[4]: (a + d) / 2.0,
            TASK_NAMES[5]: (a + b + c) / 3.0,
            "task_modifier": clip(8.0 * a + 6.0 * b + 10.0 * c + 7.0 * d - 16.1, -8.0, 12.0),
        }
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """Trait columns, derived traits and modifier; unknown preset is neutral."""
    df = df.withColumns(
        {
            t: lookup("profile", {k: v[i] for k, v in PROFILES.items()}, PROFILES["neutral"][i])
            for i, t in enumerate(TRAITS)
        }
    )
    o, c, n = F.col("openness"), F.col("conscientiousness"), F.col("neuroticism")
    return df.withColumns(
        {
            "resilience": 1.0 - n,
            "structure_preference": c,
            "exploration_preference": o,
            "profile_modifier": clip(4.0 * n - 2.5 * c - 1.5 * (1.0 - n) + 1.0 * o - 0.5, -5.0, 6.0),
        }
    )


def search_efficiency_estimate(max_peaks: int = 8) -> Column:
    """Analytic search efficiency from hierarchy, saliency and task columns."""
    return clip(
        0.40 * clip("visual_hierarchy", 0, 1)
        + 0.25 * (1.0 - clip(F.col("saliency_peak_count") / max(max_peaks, 1), 0, 1))
        + 0.20 * (1.0 - clip("saliency_dispersion", 0, 1))
        + 0.10 * (1.0 - F.col("target_specificity_weight"))
        + 0.05 * (1.0 - F.col("search_mode_weight")),
        0,
        1,
    )


def predictions(df: DataFrame) -> DataFrame:
    """Base and task/profile-adjusted score, efficiency and demand, plus level."""
    idx, aoi = F.col("cognitive_load_index"), F.col("cog_aoi_sensitivity")
    t, p = F.col("task_modifier"), F.col("profile_modifier")
    df = df.withColumns(
        {
            "base_score": idx * 100.0,
            "base_efficiency": clip(1.0 - aoi, 0, 1),
            "base_demand": clip(idx + 0.15, 0, 1),
        }
    )
    df = df.withColumns(
        {
            "score": clip(F.col("base_score") + t + p, 0, 100),
            "efficiency": clip(F.col("base_efficiency") - 0.0025 * t - 0.003 * p, 0, 1),
            "demand": clip(F.col("base_demand") + 0.004 * t + 0.004 * p, 0, 1),
        }
    )
    return df.withColumn("load_level", load_level(F.col("score")))


def load_level(score: Column) -> Column:
    return (
        F.when(score < 25, F.lit("LOW"))
        .when(score < 50, F.lit("MODERATE"))
        .when(score < 75, F.lit("HIGH"))
        .otherwise(F.lit("VERY HIGH"))
    )


def baseline_visual() -> Column:
    """Baseline A: visual features only."""
    return clip(
        25.0 * F.col("shannon_entropy")
        + 20.0 * F.col("edge_density")
        + 30.0 * F.col("feature_congestion")
        + 15.0 * F.col("subband_entropy")
        - 10.0 * F.col("visual_hierarchy"),
        0,
        100,
    )


def baseline_comparison(df: DataFrame, norms: dict = REFERENCE_NORMS) -> DataFrame:
    """Scores A (visual), B (+ load rules), C (+ task, profile) and differences.

    Whitespace, text and saliency are left out, so the three differ only in the
    rules they apply.
    """
    bare = df.withColumns(
        {
            "whitespace_ratio": F.lit(None).cast("double"),
            "text_density": F.lit(None).cast("double"),
        }
    )
    s = profile_columns(task_columns(load_features(bare, norms, saliency=False)))
    b = clip(F.col("cognitive_load_index") * 100.0, 0, 100)
    s = s.withColumns({"_a": baseline_visual(), "_b": b})
    c = clip(F.col("_b") + F.col("task_modifier") + F.col("profile_modifier"), 0, 100)
    s = s.withColumn("_c", c)
    out = {
        "baseline_a_score": F.col("_a"),
        "baseline_b_score": F.col("_b"),
        "full_score": F.col("_c"),
        "delta_b_minus_a": F.col("_b") - F.col("_a"),
        "delta_c_minus_b": F.col("_c") - F.col("_b"),
    }
    return s.withColumns(out).drop("_a", "_b", "_c")


def population_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: mean and population standard deviation (long form)."""
    long = df.unpivot([], [F.col(c).cast("double") for c in columns], "metric", "value")
    return (
        long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
    )


def coherence(
    df: DataFrame,
    spread: str = "saliency_dispersion",
    fixations: str = "estimated_fixation_count",
    search_time: str = "mean_search_time_s",
    score: str = "score",
) -> DataFrame:
    """Flags, warnings, number of rules that could be checked, overall verdict."""
    s, f, t, y = F.col(spread), F.col(fixations), F.col(search_time), F.col(score)
    have1, have2, have3 = s.isNotNull() & f.isNotNull(), s.isNotNull(), t.isNotNull()
    hit1 = have1 & (s > SPREAD_HIGH) & (f < FIXATIONS_LOW)
    hit2 = have2 & (s < SPREAD_LOW) & (y >= LOAD_HIGH)
    hit3 = have3 & (t > SEARCH_TIME_HIGH) & (y < LOAD_LOW)
    flags = F.array_compact(
        F.array(
            F.when(hit1, F.lit("saliency_fixation_mismatch")),
            F.when(hit2, F.lit("concentrated_saliency_high_load")),
            F.when(hit3, F.lit("search_time_load_mismatch")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                hit1,
                F.format_string(
                    "Attention is spread widely (%.2f) but few fixations (%.1f) are expected.", s, f
                ),
            ),
            F.when(
                hit2,
                F.format_string(
                    "Attention is concentrated (%.2f) but the load score is high (%.1f).", s, y
                ),
            ),
            F.when(
                hit3,
                F.format_string(
                    "Search is slow (%.1f s) but the load score is low (%.1f).", t, y
                ),
            ),
        )
    )
    checked = have1.cast("int") + have2.cast("int") + have3.cast("int")
    return df.withColumns(
        {
            "flags": flags,
            "warnings": warnings,
            "rules_checked": checked,
            "is_coherent": F.size(flags) == 0,
        }
    )


def full_vector(df: DataFrame) -> DataFrame:
    """The 30-element vector: visual, saliency (zero if absent), load, task, traits."""
    sal = [
        "saliency_dispersion",
        "saliency_entropy",
        "saliency_coverage",
        "saliency_peak_count",
        "saliency_center_bias",
    ]
    parts = [F.col(c) for c in VISUAL]
    parts += [F.coalesce(F.col(c), F.lit(0.0)) for c in sal]
    parts += [F.col(c) for c in LOAD_NAMES + TASK_NAMES + TRAITS]
    return df.withColumn("vector", F.array(*parts))


def classify_design(df: DataFrame) -> DataFrame:
    """Most likely design class, its probability and an out-of-domain flag."""
    probs = F.array(*[F.col(c) for c in DESIGN_CLASSES])
    names = F.array(*[F.lit(c) for c in DESIGN_CLASSES])
    top = F.array_max(probs)
    cls = F.element_at(names, F.array_position(probs, top).cast("int"))
    return df.withColumns(
        {
            "predicted_class": cls,
            "confidence": F.round(top, 4),
            "out_of_domain": cls.isin(*OUT_OF_DOMAIN),
        }
    )


def score_screens(df: DataFrame, norms: dict = REFERENCE_NORMS) -> DataFrame:
    """The whole rule chain for a feature table with task and profile keys."""
    return predictions(profile_columns(task_columns(load_features(df, norms))))


def reference_table(spark) -> DataFrame:
    return norms_table(spark, REFERENCE_NORMS)
