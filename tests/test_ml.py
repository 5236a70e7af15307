import numpy as np
import pytest
from pyspark.sql import functions as F

from ocuspark.operators import ml


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 240
    x = rng.normal(size=(n, len(ml.FEATURES))) * rng.uniform(0.5, 5, len(ml.FEATURES)) + 2
    x[:, 3] = 7.0  # a constant column
    w = rng.normal(size=(len(ml.FEATURES), 3))
    y = x @ w + rng.normal(size=(n, 3))
    rows = [(f"img_{i}", *map(float, x[i]), *map(float, y[i])) for i in range(n)]
    names = ml.FEATURES + ml.TARGETS
    df = spark.createDataFrame(rows, "image_name string, " + ", ".join(f"{c} double" for c in names))
    return df.checkpoint(), x, y


def closed_form(x, y, alpha=1.0):
    m, s = x.mean(0), x.std(0)
    s[s < 1e-12] = 1.0
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0)))
    return lambda q: (q - m) / s @ w + y.mean(0)


def test_ridge_from_moments(table):
    df, x, y = table
    g = sum(ml.fold_moments(df, ml.FEATURES, ml.TARGETS, ml.fold_of("image_name")).values())
    w, b = ml.ridge_solve(g, len(ml.FEATURES), range(len(ml.FEATURES)))
    assert x @ w + b == pytest.approx(closed_form(x, y)(x), abs=1e-8)


def test_pipeline_ridge_equals_closed_form(table, scratch):
    df, x, y = table
    model = ml.fit(df, "ridge")
    ml.save(model, f"{scratch}/ridge")
    rows = ml.load(f"{scratch}/ridge").transform(df).collect()
    got = {r.image_name: [r[f"pred_{t}"] for t in ml.TARGETS] for r in rows}
    want = closed_form(x, y)(x)
    for i in range(len(x)):
        assert got[f"img_{i}"] == pytest.approx(list(want[i]), abs=1e-8)


def test_ridge_with_collinear_and_nearly_constant_columns(spark):
    """A column of rounding noise is left out, one whose spread is exactly 1 stays, copies of a column share its weight."""
    rng = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    a = np.tile([-1.0, 1.0], 60)
    b = rng.normal(size=120)
    x = np.column_stack([a, b, 2 * b + 3, 0.3 + 1e-16 * np.arange(120)])
    y = 300 * a + 5 * b + rng.normal(size=120)
    rows = [(*map(float, q), float(v)) for q, v in zip(x, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"]))
    model = ml.fit(df, "ridge", names, ["y"])
    assert model.stages[1].getInputCols() == ["_z_a", "_z_b", "_z_c"]
    got = [r.pred_y for r in model.transform(df).orderBy("y").collect()]
    assert got == pytest.approx(list(closed_form(x, y)(x)[np.argsort(y)]), abs=1e-8)


def test_cross_validation_uses_train_folds_only(table):
    df, x, y = table
    fold = {r.image_name: r.f for r in df.select("image_name", ml.fold_of("image_name").alias("f")).collect()}
    k = np.array([fold[f"img_{i}"] for i in range(len(x))])
    for r in ml.cross_validate(df, "image_name").collect():
        p = closed_form(x[k != r.fold], y[k != r.fold])(x[k == r.fold])
        t = y[k == r.fold]
        want = np.mean(1 - ((t - p) ** 2).sum(0) / ((t - t.mean(0)) ** 2).sum(0))
        assert r.r2 == pytest.approx(want, abs=1e-7)


def test_ablation_and_gains(table):
    df, _, _ = table
    rows = ml.block_ablation(df, "image_name")
    assert rows.count() == 7
    by = {r.blocks: r.cv_r2_mean for r in rows.collect()}
    assert list(by.values()) == sorted(by.values(), reverse=True)
    gains = {r.block: r.gain for r in ml.marginal_gains(rows).collect()}
    assert gains["h"] == pytest.approx(by["v+s+h"] - by["v+s"], abs=1e-4)


def test_permutation_importance_finds_the_driver(spark):
    rng = np.random.default_rng(2)
    n = 200
    x = rng.normal(size=(n, len(ml.FEATURES)))
    rows = [(f"i{k}", *map(float, x[k]), float(10 * x[k, 5])) for k in range(n)]
    df = spark.createDataFrame(
        rows, "image_name string, " + ", ".join(f"{c} double" for c in [*ml.FEATURES, ml.TARGETS[0]]))
    out = ml.permutation_importance(df, "image_name", repeats=2, trees=10).collect()
    assert len(out) == len(ml.FEATURES)
    assert out[0].feature == ml.FEATURES[5] and out[0].block == "v"


def test_predictions_are_clipped_and_padded(table):
    df, _, _ = table
    model = ml.fit(df, "ridge")
    out = ml.predict(model, df.drop("edge_density").withColumn("layout_symmetry", F.lit(1e6)))
    for t, (lo, hi) in ml.TARGET_RANGE.items():
        row = out.agg(F.min(f"pred_{t}"), F.max(f"pred_{t}")).first()
        assert lo <= row[0] and row[1] <= hi


def test_cross_validation_does_not_depend_on_the_mean(spark):
    import numpy as np

    from ocuspark.operators import ml

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(ml.FEATURES)))
    y = np.column_stack([x[:, k] + 0.1 * rng.normal(size=400) for k in range(len(ml.TARGETS))])
    names = [*ml.FEATURES, *ml.TARGETS]
    scores = []
    for mean in (0.0, 1e8):
        rows = [(str(i), *map(float, np.concatenate([a + mean, b]))) for i, (a, b) in enumerate(zip(x, y))]
        df = spark.createDataFrame(rows, ["image_name", *names])
        scores.append([r.r2 for r in ml.cross_validate(df, "image_name").orderBy("fold").collect()])
    assert np.allclose(scores[0], scores[1], atol=1e-5) and min(scores[0]) > 0.9


@pytest.mark.parametrize("name, operator", [("ml_model_comparison", "compare_models"), ("ml_forest_holdout", "holdout_metrics"), ("ml_permutation_importance", "permutation_importance")])
def test_registered_models_have_the_documented_size(monkeypatch, name, operator):
    from ocuspark.plans import ml_plans
    from ocuspark.plans.registry import QUERIES

    seen = []
    monkeypatch.setattr(ml_plans, "_train", lambda t: None)
    monkeypatch.setattr(ml_plans, "cut", lambda df: df)
    monkeypatch.setattr(ml, operator, lambda df, key, *args, **settings: seen.append((args, settings)))
    QUERIES[name](None, "")
    (args, settings), = seen
    assert settings == {} and args in ((), ("forest",))  # all targets, trees, rounds and repeats of operators/ml.py
