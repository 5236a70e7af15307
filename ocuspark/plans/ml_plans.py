"""Model queries on the training table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import ml
from ocuspark.operators.lineage import cut
from ocuspark.plans.registry import query
from ocuspark.plans.study_plans import LOOKUP

T = ("aoi_trials",)
TRAIN_SQL = LOOKUP.rstrip() + """,
tr AS (SELECT image_name, 5 + bfix / 20 * 2 AS shannon_entropy, 0.05e0 + bfreq / 5 * 0.3e0 AS edge_density, bfix / 20 * 0.8e0 AS feature_congestion,
  bdur / 1000 * 3 AS subband_entropy, 1 - bfix / 20 * 0.3e0 AS layout_symmetry, bfreq / 5 * 0.6e0 AS chromatic_coherence,
  1 - bdur / 1000 * 0.5e0 AS visual_hierarchy, bfix / 20 * 50 AS interactive_element_density,
  0.3e0 + bfix / 20 * 0.5e0 AS saliency_dispersion, 0.1e0 + bfreq / 5 * 0.2e0 AS saliency_entropy, bfix / 20 * 0.7e0 AS saliency_coverage,
  greatest(1, bfix / 20 * 8) AS saliency_peak_count, bfreq / 5 * 0.5e0 AS saliency_center_bias,
  fixation_reduction AS cog_fixation_reduction, duration_increase AS cog_duration_increase, exploration_reduction AS cog_exploration_reduction,
  aoi_sensitivity AS cog_aoi_sensitivity, highlight_effectiveness, cognitive_load_index,
  cognitive_load_index * 100 AS cognitive_load_score, least(greatest((fixation_reduction - 0.5e0) / 0.6e0, 0), 1) AS search_efficiency,
  least(greatest((duration_increase - 0.8e0) / 0.7e0, 0), 1) AS attention_demand FROM lookup)
"""
COLS = ml.FEATURES + ml.TARGETS


def _train(t):
    return ml.training_rows(t["aoi_trials"])


@query(
    "ml_training_table",
    TRAIN_SQL + "SELECT image_name, " + ", ".join(f"round({c}, 10) AS {c}" for c in COLS) + ", true AS targets_leak FROM tr",
    T,
)
def _(t):
    return _train(t).select("image_name", *[F.round(c, 10).alias(c) for c in COLS], "targets_leak")


SCALED = ["shannon_entropy", "edge_density", "saliency_coverage", "cog_duration_increase"]


@query(
    "ml_standardised",
    TRAIN_SQL + "SELECT image_name, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED
    ) + " FROM tr",
    T,
)
def _(t):
    return ml.standardise(_train(t), SCALED).select("image_name", *[r6(c).alias(c) for c in SCALED])


@query(
    "ml_regression_metrics",
    TRAIN_SQL + """, p AS (SELECT 'efficiency' AS output, search_efficiency AS y, cog_fixation_reduction AS q FROM tr
      UNION ALL SELECT 'demand', attention_demand, cog_duration_increase / 2 FROM tr)
    SELECT output, count(*) AS n, round(1 - sum(pow(y - q, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(pow(y - q, 2))), 6) AS rmse,
      round(avg(abs(y - q)), 6) AS mae FROM p GROUP BY 1""",
    T,
)
def _(t):
    d = _train(t).withColumns(
        {"q1": F.col("cog_fixation_reduction"), "q2": F.col("cog_duration_increase") / 2}
    )
    m = ml.regression_metrics(d, {"efficiency": ("search_efficiency", "q1"), "demand": ("attention_demand", "q2")})
    return m.select("output", "n", r6("r2").alias("r2"), r6("rmse").alias("rmse"), r6("mae").alias("mae"))


# ---- Ridge in plain SQL ----------------------------------------------------
# The twins of the linear models: standardised columns, sums of products and a
# Gauss elimination as a recursive table, one matrix per combination and fold.

N = len(ml.FEATURES)
COMBOS = [c for size in (1, 2, 3) for c in combinations(ml.BLOCKS, size)]
USED = ", ".join(
    f"('{'+'.join(c)}', {ml.FEATURES.index(f) + 1})" for c in COMBOS for b in c for f in ml.BLOCKS[b]
)
BY_FOLD = f"SELECT fold AS g, image_name, h % {ml.FOLDS} <> fold AS train FROM f, range({ml.FOLDS}) r(fold)"
BY_PART = f"SELECT 0 AS g, image_name, h % 10000 >= {int(ml.HOLDOUT * 10_000)} AS train FROM f"
ALL_ROWS = "SELECT 0 AS g, image_name, true AS train FROM f"


def _ridge_sql(member: str, combos: str = "c = 'v+s+h'") -> str:
    """Tables up to pred(c, g, image_name, train, k, y, p) for the rows and parts that ``member`` names."""
    return TRAIN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
f AS (SELECT *, CAST('0x' || substr(md5(image_name || ':42'), 1, 8) AS BIGINT) AS h FROM tr),
member AS ({member}),
used AS (SELECT c, j, row_number() OVER (PARTITION BY c ORDER BY j) AS i FROM (VALUES {USED}) u(c, j) WHERE {combos}),
cols AS (SELECT c, j FROM used UNION ALL SELECT DISTINCT c, {N} + k FROM used, range(1, {len(ml.TARGETS) + 1}) t(k)),
xs AS (SELECT image_name, unnest(range(1, {N + 1})) AS j, unnest([{", ".join(ml.FEATURES)}]) AS x FROM f),
ys AS (SELECT image_name, unnest(range(1, {len(ml.TARGETS) + 1})) AS k, unnest([{", ".join(ml.TARGETS)}]) AS y FROM f),
st AS (SELECT g, j, avg(x) AS m, stddev_pop(x) AS s FROM member JOIN xs USING (image_name) WHERE train GROUP BY 1, 2),
z AS (SELECT g, image_name, train, j, (x - m) / CASE WHEN s > 1e-12 * greatest(abs(m), 1) THEN s ELSE 1 END AS z
  FROM member JOIN xs USING (image_name) JOIN st USING (g, j)),
yc AS (SELECT g, image_name, train, k, y, avg(y) FILTER (train) OVER (PARTITION BY g, k) AS my FROM member JOIN ys USING (image_name)),
prod AS (SELECT a.g, a.j AS i, b.j AS j, sum(a.z * b.z) + CASE WHEN a.j = b.j THEN {ml.ALPHA} ELSE 0 END AS v
    FROM z a JOIN z b ON a.g = b.g AND a.image_name = b.image_name WHERE a.train GROUP BY 1, 2, 3
  UNION ALL SELECT z.g, j, {N} + k, sum(z * (y - my)) FROM z JOIN yc ON z.g = yc.g AND z.image_name = yc.image_name WHERE z.train GROUP BY 1, 2, 3),
lines AS (SELECT u.c, p.g, u.i, list(p.v ORDER BY p.j) AS r FROM prod p JOIN used u ON u.j = p.i
  JOIN cols ON cols.c = u.c AND cols.j = p.j GROUP BY 1, 2, 3),
gauss(c, g, step, m) AS (SELECT c, g, CAST(1 AS BIGINT), list(r ORDER BY i) FROM lines GROUP BY 1, 2
  UNION ALL SELECT c, g, step + 1, list_transform(m, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda x: x / r[step])
    ELSE list_transform(r, lambda x, j: x - r[step] * m[step][j] / m[step][step]) END) FROM gauss WHERE step <= len(m)),
w AS (SELECT c, g, u.j, k, m[u.i][len(m) + k] AS w FROM gauss JOIN used u USING (c), range(1, {len(ml.TARGETS) + 1}) t(k) WHERE step = len(m) + 1),
pred AS (SELECT c, z.g, z.image_name, z.train, k, any_value(y) AS y, any_value(my) + sum(z * w) AS p
  FROM z JOIN w ON w.g = z.g AND w.j = z.j JOIN yc USING (k) WHERE yc.g = z.g AND yc.image_name = z.image_name GROUP BY 1, 2, 3, 4, 5)
"""


SCORES = """, parts AS (SELECT c, g, k, CASE WHEN var_pop(y) > 0 THEN 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) ELSE 0 END AS r2
  FROM pred WHERE NOT train GROUP BY 1, 2, 3),
scores AS (SELECT c, g, avg(r2) AS r2 FROM parts GROUP BY 1, 2)
"""
NAMES = "CASE k " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(ml.TARGETS, 1)) + " END"


@query(
    "ml_ridge_holdout",
    _ridge_sql(BY_PART) + f"""SELECT {NAMES} AS output, count(*) AS n, CASE WHEN train THEN 'train' ELSE 'val' END AS part, 'ridge' AS model,
      round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(pow(y - p, 2))), 5) AS rmse,
      round(avg(abs(y - p)), 5) AS mae FROM pred GROUP BY k, train""",
    T,
)
def _(t):
    m = ml.holdout_metrics(cut(_train(t)), "image_name", "ridge")
    return m.select("output", "n", "part", "model", *[F.round(c, 5).alias(c) for c in ("r2", "rmse", "mae")])


@query("ml_forest_holdout", None)
def _(t):
    return ml.holdout_metrics(cut(_train(t)), "image_name", "forest")


@query("ml_model_comparison", None)
def _(t):
    return ml.compare_models(cut(_train(t)), "image_name")


@query("ml_cross_validation", _ridge_sql(BY_FOLD) + SCORES + "SELECT CAST(g AS INT) AS fold, round(r2, 6) AS r2 FROM scores", T)
def _(t):
    return ml.cross_validate(_train(t), "image_name").select("fold", r6("r2").alias("r2"))


ABLATION = _ridge_sql(BY_FOLD, "true") + SCORES + """, ab AS (SELECT c AS blocks, (SELECT count(*) FROM used WHERE used.c = scores.c) AS n_features,
  round(avg(r2), 4) AS cv_r2_mean, round(stddev_pop(r2), 4) AS cv_r2_std FROM scores GROUP BY c)
"""


@query("ml_block_ablation", ABLATION + "SELECT blocks, CAST(n_features AS INT) AS n_features, cv_r2_mean, cv_r2_std FROM ab", T)
def _(t):
    return ml.block_ablation(_train(t), "image_name")


@query(
    "ml_marginal_gains",
    ABLATION + """SELECT d.block, round(a.cv_r2_mean - b.cv_r2_mean, 4) AS gain FROM ab a, ab b, (VALUES ('v', 's+h'), ('s', 'v+h'), ('h', 'v+s')) d(block, rest)
    WHERE a.blocks = 'v+s+h' AND b.blocks = d.rest""",
    T,
)
def _(t):
    return ml.marginal_gains(ml.block_ablation(_train(t), "image_name"))


@query("ml_permutation_importance", None)
def _(t):
    return ml.permutation_importance(cut(_train(t)), "image_name")


@query(
    "ml_batch_prediction",
    _ridge_sql(ALL_ROWS) + "SELECT image_name, " + ", ".join(
        f"round(max(least(greatest(p, {low}), {high})) FILTER (k = {k}), 5) AS pred_{name}"
        for k, (name, (low, high)) in enumerate(ml.TARGET_RANGE.items(), 1)
    ) + " FROM pred GROUP BY 1",
    T,
)
def _(t):
    train = cut(_train(t))
    out = ml.predict(ml.fit(train, "ridge"), train)
    return out.select("image_name", *[F.round(f"pred_{c}", 5).alias(f"pred_{c}") for c in ml.TARGETS])
