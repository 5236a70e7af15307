"""Study queries over the trial table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import ranks, study
from ocuspark.plans.registry import query

CLEAN = """
WITH clean AS (SELECT * REPLACE (
    CASE WHEN total_num_fixations >= 0 THEN total_num_fixations END AS total_num_fixations,
    CASE WHEN mean_fixation_duration >= 0 THEN mean_fixation_duration END AS mean_fixation_duration,
    CASE WHEN total_fixation_duration >= 0 THEN total_fixation_duration END AS total_fixation_duration)
  FROM aoi_trials),
means AS (SELECT image_name, cognitive_load, avg(total_num_fixations) AS mean_fixation_count,
    avg(mean_fixation_duration) AS mean_fixation_duration,
    avg(total_fixation_duration) AS mean_total_duration, count(total_num_fixations) AS n_obs
  FROM clean GROUP BY 1, 2)
"""
METRICS3 = """round(avg(total_num_fixations), 6) AS total_num_fixations,
  round(avg(mean_fixation_duration), 6) AS mean_fixation_duration,
  round(avg(fixation_frequency), 6) AS fixation_frequency"""
T = ("aoi_trials",)


def _rounded(df, keys):
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


@query(
    "study_clean_trials",
    CLEAN + """SELECT count(*) AS n, count(total_num_fixations) AS n_fix,
      round(sum(total_num_fixations), 2) AS s_fix, count(mean_fixation_duration) AS n_dur FROM clean""",
    T,
)
def _(t):
    c = study.clean_trials(t["aoi_trials"])
    return c.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("total_num_fixations").alias("n_fix"),
        F.round(F.sum("total_num_fixations"), 2).alias("s_fix"),
        F.count("mean_fixation_duration").alias("n_dur"),
    )


@query("study_load_means", f"SELECT cognitive_load, {METRICS3} FROM aoi_trials GROUP BY 1", T)
def _(t):
    return _rounded(study.means_by(t["aoi_trials"], ["cognitive_load"]), ["cognitive_load"])


@query(
    "study_image_load_means",
    CLEAN + """SELECT image_name, cognitive_load, round(mean_fixation_count, 6) AS mean_fixation_count,
      round(mean_fixation_duration, 8) AS mean_fixation_duration,
      round(mean_total_duration, 6) AS mean_total_duration, n_obs FROM means""",
    T,
)
def _(t):
    m = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    # Two-decimal inputs averaged over 8k rows can end exactly on half of the
    # sixth decimal, so the durations keep eight.
    m = m.withColumn("mean_fixation_duration", F.round("mean_fixation_duration", 8))
    return _rounded(m, ["image_name", "cognitive_load", "n_obs", "mean_fixation_duration"])


@query(
    "study_interaction_means",
    f"SELECT highlight, cognitive_load, {METRICS3} FROM aoi_trials GROUP BY 1, 2",
    T,
)
def _(t):
    return _rounded(study.interaction_means(t["aoi_trials"]), ["highlight", "cognitive_load"])


@query(
    "study_interaction_means_with_margins",
    f"SELECT highlight, cognitive_load, {METRICS3} FROM aoi_trials GROUP BY CUBE (highlight, cognitive_load)",
    T,
)
def _(t):
    out = study.interaction_means(t["aoi_trials"], margins=True)
    return _rounded(out, ["highlight", "cognitive_load"])


@query(
    "study_aoi_hit_rate",
    "SELECT cognitive_load, highlight, round(avg(aoi_hit), 6) AS aoi_hit_rate FROM aoi_trials GROUP BY 1, 2",
    T,
)
def _(t):
    return _rounded(study.hit_rate(t["aoi_trials"]), ["cognitive_load", "highlight"])


PIVOT = """WITH im AS (SELECT image_name, cognitive_load, avg(total_num_fixations) AS v FROM aoi_trials GROUP BY 1, 2),
wide AS (SELECT image_name, max(CASE cognitive_load WHEN 'Absent' THEN v END) AS absent,
    max(CASE cognitive_load WHEN 'High' THEN v END) AS high,
    max(CASE cognitive_load WHEN 'Low' THEN v END) AS low FROM im GROUP BY 1),
ratio AS (SELECT *, CASE WHEN absent <> 0 THEN high / absent END AS sensitivity_high FROM wide)
"""


def _ratios(t):
    image_means = study.means_by(t["aoi_trials"], ["image_name", "cognitive_load"])
    return study.sensitivity_ratio(study.pivot_loads(image_means, "total_num_fixations"))


@query(
    "study_sensitivity_ratio_pivot",
    PIVOT + """SELECT image_name, round(absent, 6) AS absent, round(high, 6) AS high, round(low, 6) AS low,
      round(sensitivity_high, 6) AS sensitivity_high FROM ratio""",
    T,
)
def _(t):
    return _rounded(_ratios(t), ["image_name"])


@query(
    "study_sensitivity_describe",
    PIVOT + """SELECT count(sensitivity_high) AS n, round(avg(sensitivity_high), 6) AS mean,
      round(stddev_samp(sensitivity_high), 6) AS std, round(min(sensitivity_high), 6) AS min,
      round(max(sensitivity_high), 6) AS max, round(quantile_cont(sensitivity_high, 0.25), 6) AS p25,
      round(quantile_cont(sensitivity_high, 0.5), 6) AS p50,
      round(quantile_cont(sensitivity_high, 0.75), 6) AS p75 FROM ratio""",
    T,
)
def _(t):
    return _rounded(study.describe(_ratios(t), "sensitivity_high"), ["n"])


@query(
    "study_baseline_describe",
    """WITH b AS (SELECT image_name, avg(mean_fixation_duration) AS v FROM aoi_trials
      WHERE cognitive_load = 'Absent' AND highlight = 'Absent' GROUP BY 1)
    SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
      round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.75), 6) AS p75 FROM b""",
    T,
)
def _(t):
    base = study.means_by(study.baseline(t["aoi_trials"]), ["image_name"])
    return _rounded(study.describe(base, "mean_fixation_duration"), ["n"])


LOOKUP = """
WITH cell AS (SELECT image_name, cognitive_load, highlight, avg(total_num_fixations) AS fix,
    avg(mean_fixation_duration) AS dur, avg(fixation_frequency) AS freq FROM aoi_trials GROUP BY 1, 2, 3),
b AS (SELECT * FROM cell WHERE cognitive_load = 'Absent' AND highlight = 'Absent'),
h AS (SELECT * FROM cell WHERE cognitive_load = 'High' AND highlight = 'Absent'),
d AS (SELECT * FROM cell WHERE cognitive_load = 'High' AND highlight = 'Dynamic'),
terms AS (SELECT b.image_name, CASE WHEN b.fix > 0 THEN h.fix / b.fix ELSE 1 END AS fixation_reduction,
    CASE WHEN b.dur > 0 THEN h.dur / b.dur ELSE 1 END AS duration_increase,
    CASE WHEN b.freq > 0 THEN h.freq / b.freq ELSE 1 END AS exploration_reduction, 0.4e0 AS aoi_sensitivity,
    CASE WHEN d.image_name IS NULL THEN 0.7e0 WHEN b.fix > 0 THEN d.fix / b.fix ELSE 0.5e0 END AS highlight_effectiveness,
    b.fix AS bfix, b.dur AS bdur, b.freq AS bfreq
  FROM b JOIN h ON b.image_name = h.image_name LEFT JOIN d ON b.image_name = d.image_name),
lookup AS (SELECT *, least(greatest((0.3e0 * (1 - fixation_reduction) + 0.2e0 * greatest(0, duration_increase - 1)
    + 0.2e0 * (1 - exploration_reduction) + 0.15e0 * aoi_sensitivity
    + 0.15e0 * (1 - highlight_effectiveness)) / 0.3e0, 0), 1) AS cognitive_load_index FROM terms)
"""
LOOKUP_COLS = [
    "fixation_reduction",
    "duration_increase",
    "exploration_reduction",
    "aoi_sensitivity",
    "highlight_effectiveness",
    "cognitive_load_index",
]


@query(
    "study_sensitivity_lookup",
    LOOKUP + "SELECT image_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in LOOKUP_COLS) + " FROM lookup",
    T,
)
def _(t):
    return _rounded(study.sensitivity_lookup(t["aoi_trials"]), ["image_name"])


@query(
    "study_images_with_both_conditions",
    """SELECT image_name, count(*) AS n FROM aoi_trials WHERE image_name IN (
      SELECT image_name FROM aoi_trials WHERE highlight = 'Absent' AND cognitive_load = 'Absent'
      INTERSECT SELECT image_name FROM aoi_trials WHERE highlight = 'Absent' AND cognitive_load = 'High') GROUP BY 1""",
    T,
)
def _(t):
    return study.both_conditions(t["aoi_trials"]).filter("both AND image_name IS NOT NULL").select("image_name", "n")


@query(
    "study_common_images",
    """SELECT image_name FROM aoi_trials WHERE cognitive_load = 'Low' INTERSECT
       SELECT image_name FROM aoi_trials WHERE cognitive_load = 'High'""",
    T,
)
def _(t):
    trials = t["aoi_trials"]
    low = study.baseline(trials, "Low", None).select("image_name")
    return low.intersect(study.baseline(trials, "High", None).select("image_name"))


def _test_sql(metric: str, first: str, second: str) -> str:
    return f"""SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(b) / avg(a) AS ratio,
    avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t_statistic,
    (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2) AS cohens_d
  FROM (SELECT x.{metric} AS a, y.{metric} AS b FROM means x JOIN means y ON x.image_name = y.image_name
        WHERE x.cognitive_load = '{first}' AND y.cognitive_load = '{second}') p"""


EFFECT = """CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small'
  WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size"""


@query(
    "study_paired_test",
    CLEAN + f"""SELECT n, n - 1 AS df, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(ratio, 6) AS ratio,
      round(t_statistic, 6) AS t_statistic, round(cohens_d, 6) AS cohens_d, {EFFECT}
      FROM ({_test_sql('mean_fixation_count', 'Absent', 'High')}) q""",
    T,
)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    out = study.paired_test(study.paired(means, "mean_fixation_count", "Absent", "High"))
    return _rounded(out, ["n", "df", "effect_size"])


def _report_sql() -> str:
    rows = []
    for name, metric, direction in (
        ("H1", "mean_fixation_count", "decrease"),
        ("H2", "mean_fixation_duration", "increase"),
    ):
        rows.append(
            f"""SELECT '{name}' AS hypothesis, '{metric}' AS metric, '{direction}' AS direction,
      n AS n_images, round(mean_a, 6) AS mean_absent, round(mean_b, 6) AS mean_high,
      round(ratio, 6) AS ratio_high_absent, round(t_statistic, 6) AS t_statistic, n - 1 AS df,
      round(cohens_d, 6) AS cohens_d, {EFFECT},
      (SELECT round(t_statistic, 6) FROM ({_test_sql(metric, 'Low', 'High')}) l) AS t_low_vs_high
      FROM ({_test_sql(metric, 'Absent', 'High')}) q"""
        )
    return CLEAN + " UNION ALL ".join(rows)


@query("study_hypothesis_report", _report_sql(), T)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    report = study.hypothesis_report(means).drop("p_value", "p_value_low_vs_high", "significant")
    return _rounded(report, ["hypothesis", "metric", "direction", "n_images", "df", "effect_size"])


# Two-sided p by Simpson's rule: with x = sqrt(df) cot(u) the tail of Student's density is
# sin(u)^(df - 1) on (0, atan(sqrt(df) / |t|)).
def _tests_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{h}' AS hypothesis, '{pair}' AS pair, n - 1 AS df, t_statistic AS t FROM ({_test_sql(metric, first, 'High')}) q"
        for h, metric in (("H1", "mean_fixation_count"), ("H2", "mean_fixation_duration"))
        for pair, first in (("main", "Absent"), ("low", "Low"))
    )


P_SQL = f"""tests AS ({_tests_sql()}),
grid AS (SELECT tests.*, i, atan(sqrt(df) / abs(t)) / 20000 AS h,
    CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM tests, range(20001) AS g(i)),
tails AS (SELECT hypothesis, pair, 2 * exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(pi())
    * sum(weight * pow(sin(i * h), df - 1)) * max(h) / 3 AS p FROM grid GROUP BY hypothesis, pair, df)
"""


@query(
    "study_hypothesis_p_values",
    CLEAN.rstrip() + ",\n" + P_SQL + """SELECT a.hypothesis, round(log10(a.p), 6) AS log10_p_value, round(log10(b.p), 6) AS log10_p_low_vs_high, a.p < 0.05 AS significant
      FROM tails a JOIN tails b ON a.hypothesis = b.hypothesis AND a.pair = 'main' AND b.pair = 'low'""",
    T,
)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    return study.hypothesis_report(means).select(
        "hypothesis",
        F.round(F.log10("p_value"), 6).alias("log10_p_value"),
        F.round(F.log10("p_value_low_vs_high"), 6).alias("log10_p_low_vs_high"),
        "significant",
    )


@query(
    "study_observed_vs_expected",
    CLEAN + f"""SELECT hypothesis, round(observed, 6) AS observed, expected, round(abs(observed - expected), 6) AS deviation,
      abs(observed - expected) < 0.05 AS within_5pct FROM (
      SELECT 'H1' AS hypothesis, ratio AS observed, 0.876e0 AS expected FROM ({_test_sql('mean_fixation_count', 'Absent', 'High')}) a
      UNION ALL SELECT 'H2', ratio, 1.082e0 FROM ({_test_sql('mean_fixation_duration', 'Absent', 'High')}) b) u""",
    T,
)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    out = study.compare_with_expected(study.hypothesis_report(means))
    return _rounded(out, ["hypothesis", "expected", "within_5pct"])


# Stems: image names without their last character or wrapped in a longer name.
STEMS = """SELECT stem, avg(score) AS score FROM (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN concat('img_', CAST(o_orderkey % 150 AS VARCHAR(9)))
      WHEN 1 THEN concat('shot-img_', CAST(o_orderkey % 150 AS VARCHAR(9)), '-full')
      ELSE concat('other_', CAST(o_orderkey % 150 AS VARCHAR(9))) END AS stem,
    o_totalprice / 1000 AS score FROM {orders} o) s GROUP BY stem"""
EFFECTS_SQL = CLEAN + """, effect AS (SELECT x.image_name, (y.mean_fixation_count - x.mean_fixation_count) / x.mean_fixation_count AS cl_effect
  FROM means x JOIN means y ON x.image_name = y.image_name WHERE x.cognitive_load = 'Absent' AND y.cognitive_load = 'High'),
stems AS (""" + STEMS.replace("{orders}", "orders") + """),
matched AS (SELECT stem, min(image_name) AS name FROM stems JOIN (SELECT DISTINCT image_name FROM aoi_trials) i
  ON contains(stem, image_name) OR contains(image_name, stem) GROUP BY 1)
"""


def _stems(t):
    return t.spark.sql(STEMS, orders=t["orders"])


def _matched(t):
    return study.fuzzy_match(
        _stems(t), t["aoi_trials"].select(F.col("image_name").alias("name"))
    )


@query("study_fuzzy_name_match", EFFECTS_SQL + "SELECT stem, name FROM matched", T)
def _(t):
    return _matched(t)


@query(
    "study_load_effect",
    EFFECTS_SQL + "SELECT image_name, round(cl_effect, 6) AS cl_effect FROM effect",
    T,
)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    return _rounded(study.load_effect(means), ["image_name"])


# Scores from sums of whole cents, which no order of adding changes: equal averages are ties on both sides.
CENT_STEMS = STEMS.replace("avg(score)", "CAST(sum(score) AS DOUBLE) / count(score) / 1e5").replace(
    "o_totalprice / 1000", "CAST(round(o_totalprice * 100) AS BIGINT)"
)


@query(
    "study_spearman_score_vs_effect",
    EFFECTS_SQL.replace(STEMS.replace("{orders}", "orders"), CENT_STEMS.replace("{orders}", "orders")) + """, pairs AS (SELECT s.score, e.cl_effect FROM stems s JOIN matched m ON s.stem = m.stem
      JOIN effect e ON m.name = e.image_name),
    ranked AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx,
      rank() OVER (ORDER BY cl_effect) + (count(*) OVER (PARTITION BY cl_effect) - 1) / 2 AS ry FROM pairs)
    SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM ranked""",
    T,
)
def _(t):
    means = study.image_condition_means(study.clean_trials(t["aoi_trials"]))
    effect = study.load_effect(means)
    pairs = (
        t.spark.sql(CENT_STEMS, orders=t["orders"])
        .join(_matched(t), "stem")
        .join(effect.withColumnRenamed("image_name", "name"), "name")
    )
    return _rounded(ranks.spearman(pairs, "score", "cl_effect"), ["n"])
