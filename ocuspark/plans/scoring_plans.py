"""Norm and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.functions.columns import as_bool, clamp_count, parse_schedule, r6
from ocuspark.functions.reference_norms import REFERENCE_NORMS, STATS
from ocuspark.operators import norms, scoring
from ocuspark.plans.registry import query

T = ("screen_features",)
TT = ("screen_features", "screen_tasks")


def _rounded(df, keys):
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


def _unpivot_sql(features) -> str:
    return " UNION ALL ".join(
        f"SELECT screen_id, category, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM screen_features"
        for f in features
    )


LONG = f"WITH long AS ({_unpivot_sql(norms.FEATURES)})\n"
QUANT = ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in norms.QUANTILES
)


@query(
    "norms_exact",
    LONG + f"""SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std,
      round(min(value), 6) AS min, round(max(value), 6) AS max, {QUANT}
      FROM long WHERE category IN ('web', 'mobile', 'desktop') GROUP BY 1""",
    T,
)
def _(t):
    return _rounded(norms.feature_norms(norms.allowed(t["screen_features"])), ["feature", "n"])


# The value at rank ceil(p n): what the approximation gives while n is below its accuracy.
RANKED = ", ".join(
    f"round(list_sort(list(value))[greatest(1, CAST(ceil({p} * count(*)) AS BIGINT))], 6) AS p{round(p * 100)}"
    for p in norms.QUANTILES
)


@query(
    "norms_approximate",
    LONG + f"""SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std,
      round(min(value), 6) AS min, round(max(value), 6) AS max, {RANKED}
      FROM long WHERE category IN ('web', 'mobile', 'desktop') GROUP BY 1""",
    T,
)
def _(t):
    return _rounded(norms.approximate_norms(norms.allowed(t["screen_features"])), ["feature", "n"])


@query(
    "norms_corpus_metadata",
    """SELECT CAST(sum(n) AS BIGINT) AS num_images, string_agg(category || ':' || n, ',' ORDER BY category) AS counts
       FROM (SELECT category, count(*) AS n FROM screen_features WHERE category <> 'poster' GROUP BY 1) c""",
    T,
)
def _(t):
    meta = norms.corpus_metadata(norms.allowed(t["screen_features"]))
    entries = F.array_sort(F.map_entries("category_counts"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return meta.select("num_images", text.alias("counts"))


@query(
    "norms_allowed_categories",
    "SELECT category, count(*) AS n FROM screen_features WHERE category IN ('web', 'mobile', 'desktop') GROUP BY 1",
    T,
)
def _(t):
    return norms.allowed(t["screen_features"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# A manifest in the raw spelling: padded names and mixed-case categories.
MANIFEST = """SELECT concat(' shot_', CAST(doc_id AS VARCHAR(9)), '.png ') AS raw_name,
  CASE doc_id % 4 WHEN 0 THEN ' Web' WHEN 1 THEN 'MOBILE ' WHEN 2 THEN 'desktop' ELSE 'Poster' END AS raw_category
  FROM {documents} d UNION ALL SELECT '  ' AS raw_name, 'web' AS raw_category FROM {labels} l"""
MANIFEST_SQL = "WITH raw AS (" + MANIFEST.replace("{documents}", "documents").replace("{labels}", "labels") + """),
manifest AS (SELECT trim(raw_name) AS name, lower(trim(raw_category)) AS category FROM raw WHERE trim(raw_name) <> ''),
gui AS (SELECT * FROM manifest WHERE category IN ('web', 'mobile', 'desktop')),
done_raw AS (SELECT concat('shot_', CAST(doc_id AS VARCHAR(9)), '.png') AS name, CAST(quality AS DOUBLE) AS f1,
    CASE WHEN toxic = 1 THEN NULL ELSE 1e0 END AS f2 FROM labels),
done AS (SELECT * FROM done_raw WHERE f1 IS NOT NULL AND f2 IS NOT NULL)
"""


def _manifest(t):
    raw = t.spark.sql(MANIFEST, documents=t["documents"], labels=t["labels"])
    return norms.clean_manifest(raw, "raw_name", "raw_category")


def _done(t):
    rows = t["labels"].select(
        F.concat(F.lit("shot_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"),
        F.col("quality").cast("double").alias("f1"),
        F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.lit(1.0)).alias("f2"),
    )
    return norms.complete_rows(rows, ["f1", "f2"])


@query("norms_manifest_clean", MANIFEST_SQL + "SELECT name, category FROM manifest")
def _(t):
    return _manifest(t)


@query(
    "norms_balanced_sample",
    MANIFEST_SQL + """SELECT name, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY name) AS k
      FROM gui) g WHERE k <= greatest(1, 100 // (SELECT count(DISTINCT category) FROM gui))""",
)
def _(t):
    return norms.balanced_sample(norms.allowed(_manifest(t)), 100)


@query(
    "norms_resume_remaining",
    MANIFEST_SQL + "SELECT name, category FROM gui WHERE name NOT IN (SELECT name FROM done)",
)
def _(t):
    return norms.still_to_do(norms.allowed(_manifest(t)), _done(t))


@query(
    "norms_progress",
    MANIFEST_SQL + """SELECT category, count(d.name) AS done, count(*) AS total,
      round(100.0 * count(d.name) / count(*), 6) AS percent
      FROM gui LEFT JOIN (SELECT DISTINCT name FROM done) d ON gui.name = d.name GROUP BY 1""",
)
def _(t):
    return _rounded(norms.progress(norms.allowed(_manifest(t)), _done(t)), ["category", "done", "total"])


@query(
    "norms_reused_and_new_rows",
    MANIFEST_SQL + """SELECT name, 'reused' AS origin FROM done UNION ALL
      SELECT name, 'new' AS origin FROM gui WHERE name NOT IN (SELECT name FROM done)""",
)
def _(t):
    done = _done(t)
    todo = norms.still_to_do(norms.allowed(_manifest(t)), done)
    return done.select("name", F.lit("reused").alias("origin")).unionByName(
        todo.select("name", F.lit("new").alias("origin"))
    )


NORM_ROWS = ", ".join(
    "('" + f + "', " + ", ".join(repr(v[s]) if s == "n" else f"{v[s]!r}e0" for s in STATS) + ")"
    for f, v in REFERENCE_NORMS.items()
)
NORM_CTE = f"norms({', '.join(['feature', *STATS])}) AS (VALUES {NORM_ROWS})"


def _percentile_sql(v: str = "value") -> str:
    xs, ps = scoring.ANCHOR_STATS, [100 * p for p in scoring.ANCHOR_SHARE]
    parts = [f"WHEN {v} <= {xs[0]} THEN 0", f"WHEN {v} >= {xs[-1]} THEN 100"]
    for (x0, p0), (x1, p1) in zip(zip(xs, ps), zip(xs[1:], ps[1:])):
        parts.append(
            f"WHEN {v} BETWEEN {x0} AND {x1} THEN CASE WHEN {x1} = {x0} THEN {p1}"
            f" ELSE {p0} + ({p1} - {p0}) * ({v} - {x0}) / ({x1} - {x0}) END"
        )
    return "CASE " + " ".join(parts) + " ELSE 50 END"


@query(
    "scoring_compare_to_norms",
    f"WITH long AS ({_unpivot_sql(norms.FEATURES)}), {NORM_CTE}," + f"""
    j AS (SELECT *, (value - mean) / std AS z FROM long JOIN norms USING (feature) WHERE std <> 0)
    SELECT screen_id, feature, round(value, 6) AS value, round(z, 6) AS z,
      round(CASE WHEN mean <> 0 THEN (value - mean) / mean * 100 END, 6) AS delta_pct,
      round(CAST({_percentile_sql()} AS DOUBLE), 6) AS percentile,
      CASE WHEN abs(z) < 1 THEN 'typical' WHEN abs(z) < 2 THEN CASE WHEN z > 0 THEN 'above_typical' ELSE 'below_typical' END
        WHEN z > 0 THEN 'far_above_typical' ELSE 'far_below_typical' END AS band, CAST(n AS BIGINT) AS n FROM j""",
    T,
)
def _(t):
    out = scoring.compare_to_norms(
        t["screen_features"], ["screen_id"], scoring.reference_table(t.spark), norms.FEATURES
    )
    return _rounded(out, ["screen_id", "feature", "band", "n"])


def _share_sql(column: str, feature: str) -> str:
    anchors: list[tuple[float, float]] = []
    for s, p in zip(scoring.ANCHOR_STATS, scoring.ANCHOR_SHARE):
        x = REFERENCE_NORMS[feature][s]
        if not anchors or x > anchors[-1][0]:
            anchors.append((x, p))
    parts = [f"WHEN {column} IS NULL THEN 0.5e0", f"WHEN {column} <= {anchors[0][0]!r}e0 THEN {anchors[0][1]}e0"]
    for (x0, p0), (x1, p1) in zip(anchors, anchors[1:]):
        parts.append(
            f"WHEN {column} <= {x1!r}e0 THEN {p0}e0 + {p1 - p0!r}e0 * ({column} - {x0!r}e0) / ({x1!r}e0 - {x0!r}e0)"
        )
    return "CASE " + " ".join(parts) + " ELSE 1e0 END"


def _load_sql(saliency: bool = True, measured: bool = True) -> str:
    """Common table expressions up to ``loads`` (the six load features)."""
    shares = ", ".join(f"{_share_sql(f, f)} AS c_{c}" for c, f in scoring.CONCEPTS.items())
    ws = "coalesce(whitespace_ratio, 1 - c_element_count)" if measured else "1 - c_element_count"
    txt = "coalesce(text_density, 0.5e0)" if measured else "0.5e0"
    complexity = "(c_edge_density + c_element_count + c_layout_complexity) / 3"
    need = complexity
    if saliency:
        spread = _share_sql("saliency_dispersion", "saliency_dispersion")
        cover = _share_sql("saliency_coverage", "saliency_coverage")
        need = f"(({spread}) + 1 - ({cover})) / 2"
    return f"""
concepts AS (SELECT *, {shares} FROM screen_features),
parts AS (SELECT *, least(greatest({ws}, 0), 1) AS ws, least(greatest({txt}, 0), 1) AS txt,
    {complexity} AS complexity, {need} AS need FROM concepts),
rules AS (SELECT *, least(greatest(0.876e0 - 0.05e0 * (complexity - ws), 0.6e0), 1.1e0) AS cog_fixation_reduction,
    least(greatest(1.081e0 + 0.1e0 * ((txt + c_element_count) / 2), 0.8e0), 1.5e0) AS cog_duration_increase,
    least(greatest(0.935e0 - 0.04e0 * (1 - (c_symmetry + c_grid_quality) / 2), 0.7e0), 1e0) AS cog_exploration_reduction,
    least(greatest((0.115e0 - 0.069e0) / 0.115e0 * (0.7e0 + 0.6e0 * (1 - ws)), 0e0), 1e0) AS cog_aoi_sensitivity,
    least(greatest(0.5e0 + 0.4e0 * need, 0e0), 1e0) AS highlight_effectiveness FROM parts),
loads AS (SELECT *, least(greatest((0.3e0 * (1 - cog_fixation_reduction) + 0.2e0 * (cog_duration_increase - 1)
    + 0.2e0 * (1 - cog_exploration_reduction) + 0.15e0 * cog_aoi_sensitivity
    + 0.15e0 * (1 - highlight_effectiveness)) / 0.3e0, 0e0), 1e0)
    * least(greatest(greatest(c_edge_density, c_element_count, c_layout_complexity, 1 - ws), 0e0), 1e0)
    AS cognitive_load_index FROM rules)"""


def _case(column: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default}e0 END"


TASK_SQL = f"""
tasks AS (SELECT *, {_case('task_type', scoring.TASK_TYPE, 0.65)} AS task_type_weight,
    {_case('target_specificity', scoring.SPECIFICITY, 0.55)} AS target_specificity_weight,
    {_case('time_pressure', scoring.TIME_PRESSURE, 0.55)} AS time_pressure_weight,
    {_case('search_mode', scoring.SEARCH_MODE, 0.30)} AS search_mode_weight,
    {', '.join(_case('profile', {k: v[i] for k, v in scoring.PROFILES.items()}, 0.5) + ' AS ' + n
               for i, n in enumerate(scoring.TRAITS))}
  FROM screen_tasks),
mods AS (SELECT *, (task_type_weight + search_mode_weight) / 2 AS visual_search_intensity,
    (task_type_weight + target_specificity_weight + time_pressure_weight) / 3 AS decisional_demand,
    least(greatest(8 * task_type_weight + 6 * target_specificity_weight + 10 * time_pressure_weight
      + 7 * search_mode_weight - 16.1e0, -8), 12) AS task_modifier,
    least(greatest(4 * neuroticism - 2.5e0 * conscientiousness - 1.5e0 * (1 - neuroticism) + openness - 0.5e0, -5), 6)
      AS profile_modifier FROM tasks)"""

SCORED = f"""WITH {_load_sql().strip()},{TASK_SQL},
scored AS (SELECT l.*, m.* EXCLUDE (screen_id), 100 * cognitive_load_index AS base_score,
    least(greatest(1 - cog_aoi_sensitivity, 0), 1) AS base_efficiency,
    least(greatest(cognitive_load_index + 0.15e0, 0), 1) AS base_demand
  FROM loads l JOIN mods m ON l.screen_id = m.screen_id),
final AS (SELECT *, least(greatest(base_score + task_modifier + profile_modifier, 0), 100) AS score,
    least(greatest(base_efficiency - 0.0025e0 * task_modifier - 0.003e0 * profile_modifier, 0), 1) AS efficiency,
    least(greatest(base_demand + 0.004e0 * task_modifier + 0.004e0 * profile_modifier, 0), 1) AS demand FROM scored)
"""


def _inputs(t):
    return t["screen_features"].join(t["screen_tasks"], "screen_id")


def _cols(names) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


@query(
    "scoring_load_features",
    f"WITH {_load_sql().strip()} SELECT screen_id, {_cols(scoring.LOAD_NAMES)} FROM loads",
    T,
)
def _(t):
    s = scoring.load_features(t["screen_features"])
    return s.select("screen_id", *[r6(c).alias(c) for c in scoring.LOAD_NAMES])


TASK_OUT = scoring.TASK_NAMES + ["task_modifier"]


@query(
    "scoring_task_vector",
    f"WITH {TASK_SQL.strip()} SELECT screen_id, {_cols(TASK_OUT)} FROM mods",
    ("screen_tasks",),
)
def _(t):
    s = scoring.task_columns(t["screen_tasks"])
    return s.select("screen_id", *[r6(c).alias(c) for c in TASK_OUT])


PROFILE_OUT = scoring.TRAITS + ["profile_modifier"]


@query(
    "scoring_profile_traits",
    f"""WITH {TASK_SQL.strip()} SELECT screen_id, {_cols(PROFILE_OUT)}, round(1 - neuroticism, 6) AS resilience,
      conscientiousness AS structure_preference, openness AS exploration_preference FROM mods""",
    ("screen_tasks",),
)
def _(t):
    s = scoring.profile_columns(t["screen_tasks"])
    names = PROFILE_OUT + ["resilience", "structure_preference", "exploration_preference"]
    return s.select("screen_id", *[r6(c).alias(c) for c in names])


@query(
    "scoring_search_efficiency",
    SCORED + """SELECT screen_id, round(least(greatest(0.4e0 * least(greatest(visual_hierarchy, 0), 1)
      + 0.25e0 * (1 - least(greatest(saliency_peak_count / 8, 0), 1))
      + 0.2e0 * (1 - least(greatest(saliency_dispersion, 0), 1)) + 0.1e0 * (1 - target_specificity_weight)
      + 0.05e0 * (1 - search_mode_weight), 0), 1), 6) AS efficiency FROM final""",
    TT,
)
def _(t):
    s = scoring.task_columns(_inputs(t))
    return s.select("screen_id", r6(scoring.search_efficiency_estimate()).alias("efficiency"))


PRED = ["base_score", "base_efficiency", "base_demand", "score", "efficiency", "demand"]


@query(
    "scoring_predictions",
    SCORED + f"""SELECT screen_id, {_cols(PRED)}, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MODERATE'
      WHEN score < 75 THEN 'HIGH' ELSE 'VERY HIGH' END AS load_level FROM final""",
    TT,
)
def _(t):
    s = scoring.score_screens(_inputs(t))
    return s.select("screen_id", *[r6(c).alias(c) for c in PRED], "load_level")


BASE_SQL = f"""WITH {_load_sql(saliency=False, measured=False).strip()},{TASK_SQL},
abc AS (SELECT l.screen_id, least(greatest(25 * shannon_entropy + 20 * edge_density + 30 * feature_congestion
      + 15 * subband_entropy - 10 * visual_hierarchy, 0), 100) AS a,
    least(greatest(cognitive_load_index * 100, 0), 100) AS b, task_modifier, profile_modifier
  FROM loads l JOIN mods m ON l.screen_id = m.screen_id),
scores AS (SELECT screen_id, a AS baseline_a_score, b AS baseline_b_score,
    least(greatest(b + task_modifier + profile_modifier, 0), 100) AS full_score FROM abc),
compared AS (SELECT *, baseline_b_score - baseline_a_score AS delta_b_minus_a,
    full_score - baseline_b_score AS delta_c_minus_b FROM scores)
"""
BASE_OUT = ["baseline_a_score", "baseline_b_score", "full_score", "delta_b_minus_a", "delta_c_minus_b"]


@query(
    "scoring_baseline_comparison",
    BASE_SQL + f"SELECT screen_id, {_cols(BASE_OUT)} FROM compared",
    TT,
)
def _(t):
    s = scoring.baseline_comparison(_inputs(t))
    return s.select("screen_id", *[r6(c).alias(c) for c in BASE_OUT])


@query(
    "scoring_baseline_summary",
    BASE_SQL + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM compared"
        for c in BASE_OUT
    ),
    TT,
)
def _(t):
    return _rounded(
        scoring.population_summary(scoring.baseline_comparison(_inputs(t)), BASE_OUT), ["metric", "n"]
    )


H1 = "saliency_dispersion > 0.55 AND estimated_fixation_count < 6"
H2 = "saliency_dispersion < 0.25 AND score >= 60"
H3 = "mean_search_time_s > 4 AND score < 35"


@query(
    "scoring_coherence",
    SCORED + f"""SELECT screen_id, concat_ws('|', CASE WHEN {H1} THEN 'saliency_fixation_mismatch' END,
        CASE WHEN {H2} THEN 'concentrated_saliency_high_load' END,
        CASE WHEN {H3} THEN 'search_time_load_mismatch' END) AS flags,
      (CASE WHEN {H1} THEN 1 ELSE 0 END) + (CASE WHEN {H2} THEN 1 ELSE 0 END) + (CASE WHEN {H3} THEN 1 ELSE 0 END) AS n_warnings,
      1 + (CASE WHEN estimated_fixation_count IS NOT NULL THEN 1 ELSE 0 END)
        + (CASE WHEN mean_search_time_s IS NOT NULL THEN 1 ELSE 0 END) AS rules_checked,
      NOT (coalesce({H1}, false) OR coalesce({H2}, false) OR coalesce({H3}, false)) AS is_coherent FROM final""",
    TT,
)
def _(t):
    s = scoring.coherence(scoring.score_screens(_inputs(t)))
    return s.select(
        "screen_id",
        F.array_join("flags", "|").alias("flags"),
        F.size("warnings").alias("n_warnings"),
        "rules_checked",
        "is_coherent",
    )


VEC = (
    norms.VISUAL
    + ["saliency_dispersion", "saliency_entropy", "saliency_coverage", "saliency_peak_count", "saliency_center_bias"]
    + scoring.LOAD_NAMES + scoring.TASK_NAMES + scoring.TRAITS
)


@query(
    "scoring_full_vector",
    SCORED + "SELECT screen_id, pos, round(value, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT screen_id, {i} AS pos, CAST({c} AS DOUBLE) AS value FROM final" for i, c in enumerate(VEC)
    ) + ") v",
    TT,
)
def _(t):
    s = scoring.full_vector(scoring.score_screens(_inputs(t)))
    return s.select("screen_id", F.posexplode("vector").alias("pos", "value")).select(
        "screen_id", "pos", r6("value").alias("value")
    )


PROBS = ", ".join(scoring.DESIGN_CLASSES)


@query(
    "scoring_design_class",
    f"""SELECT screen_id, list_extract(['{"', '".join(scoring.DESIGN_CLASSES)}'],
        CAST(list_position([{PROBS}], greatest({PROBS})) AS INT)) AS predicted_class,
      round(greatest({PROBS}), 4) AS confidence, NOT (desktop_ui = greatest({PROBS})) AS out_of_domain
      FROM class_probabilities""",
    ("class_probabilities",),
)
def _(t):
    s = scoring.classify_design(t["class_probabilities"])
    return s.select("screen_id", "predicted_class", "confidence", "out_of_domain")


@query(
    "scoring_lookup_or_estimate",
    f"WITH {_load_sql().strip()}" + """,
    cell AS (SELECT screen_id, CASE WHEN screen_id % 3 = 0 THEN 0.9e0 END AS m FROM screen_features)
    SELECT l.screen_id, round(coalesce(m, cog_fixation_reduction), 6) AS cog_fixation_reduction,
      round(coalesce(m, cognitive_load_index), 6) AS cognitive_load_index,
      CASE WHEN m IS NOT NULL THEN 'lookup' ELSE 'estimate' END AS source
    FROM loads l JOIN cell c ON l.screen_id = c.screen_id""",
    T,
)
def _(t):
    names = ["fixation_reduction", "duration_increase", "exploration_reduction", "aoi_sensitivity"]
    names += ["highlight_effectiveness", "cognitive_load_index"]
    measured = t["screen_features"].filter("screen_id % 3 = 0").select(
        "screen_id", *[F.lit(0.9).alias(n) for n in names]
    )
    s = scoring.lookup_or_estimate(scoring.load_features(t["screen_features"]), measured, "screen_id")
    return s.select(
        "screen_id",
        r6("cog_fixation_reduction").alias("cog_fixation_reduction"),
        r6("cognitive_load_index").alias("cognitive_load_index"),
        "source",
    )


@query(
    "scoring_request_parameters",
    """SELECT event_id, lower(trim(flag)) IN ('1', 'true', 'yes', 'on') AS use_saliency,
      least(greatest(coalesce(try_cast(runs AS BIGINT), 100), 1), 500) AS n_simulations
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN ' True ' WHEN 'click' THEN 'on' WHEN 'error' THEN '0'
        ELSE 'no' END AS flag,
      CASE WHEN event_id % 7 = 0 THEN 'many' WHEN event_id % 5 = 0 THEN CAST(-event_id AS VARCHAR(19))
        ELSE CAST(event_id AS VARCHAR(19)) END AS runs FROM events) e""",
)
def _(t):
    e = t["events"].select(
        "event_id",
        F.when(F.col("event_type") == "view", " True ").when(F.col("event_type") == "click", "on")
        .when(F.col("event_type") == "error", "0").otherwise("no").alias("flag"),
        F.when(F.col("event_id") % 7 == 0, F.lit("many"))
        .when(F.col("event_id") % 5 == 0, (-F.col("event_id")).cast("string"))
        .otherwise(F.col("event_id").cast("string")).alias("runs"),
    )
    return e.select(
        "event_id", as_bool("flag").alias("use_saliency"), clamp_count("runs").alias("n_simulations")
    )


@query(
    "scoring_exposure_schedule",
    """SELECT event_id, unnest(CASE WHEN event_id % 11 = 0 THEN [1, 10, 100] ELSE
        list_sort(list_distinct([1 + CAST(event_id % 9 AS INT), 1 + CAST(event_id % 5 AS INT), 20])) END) AS exposures
    FROM events WHERE event_id % 11 = 0 OR event_id % 13 <> 0""",
)
def _(t):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(
        F.concat_ws(
            ",",
            (F.col("event_id") % 9 + 1).cast("string"),
            # One list in thirteen asks for zero exposures and is rejected.
            F.when(F.col("event_id") % 13 == 0, F.lit("0")).otherwise((F.col("event_id") % 5 + 1).cast("string")),
            F.lit(" 20 "),
        )
    )
    e = t["events"].select("event_id", parse_schedule(text).alias("schedule"))
    return e.select("event_id", F.explode("schedule").alias("exposures"))
