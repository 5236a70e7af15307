import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocuspark.operators import maps, ranks, study
from ocuspark.operators.skew import split_join
from ocuspark.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [("hot", 1.0)] * 400 + [("hot", rng.gauss(0, 1)) for _ in range(300)]
    rows += [("b", float(rng.randrange(6))) for _ in range(80)] + [("c", 2.5)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_quantiles_are_exact(values):
    rows, df = values
    out = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.95], 7).collect()}
    for g in ("hot", "b", "c"):
        v = [x for k, x in rows if k == g]
        want = np.quantile(v, [0.05, 0.5, 0.95])
        assert [out[g].p5, out[g].p50, out[g].p95] == pytest.approx(list(want), abs=1e-12)


def test_bucket_count_does_not_matter(values):
    _, df = values
    a = {r.g: r.p50 for r in ranks.exact_quantiles(df, ["g"], "v", [0.5], 2).collect()}
    b = {r.g: r.p50 for r in ranks.exact_quantiles(df, ["g"], "v", [0.5], 50).collect()}
    assert a == b


def average_rank(v):
    return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]


def test_spearman_with_ties(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(8)), rng.gauss(0, 1)) for _ in range(120)]
    got = ranks.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    rx, ry = average_rank([r[0] for r in rows]), average_rank([r[1] for r in rows])
    assert got.rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert got.n == 120


def test_spearman_query_ties_equal_averages(spark, scratch):
    """Two images have the same prices in another order: their average scores are one tie, whatever the order of adding."""
    prices = {0: (100.0, 200.0, 300.0), 3: (300.0, 200.0, 100.0), 6: (900.0, 800.0, 700.0)}
    orders = [(image + 150 * i, "F", p) for image, own in prices.items() for i, p in enumerate(own)]
    lines = [(o, o % 150, 1, 1, q, 1.0, 0.0, flag, "F") for o, _, _ in orders for flag, q in (("A", 10.0), ("R", 11.0 + o % 150))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{scratch}/orders.parquet")
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kinds).write.parquet(f"{scratch}/lineitem.parquet")
    got = QUERIES["study_spearman_score_vs_effect"](spark, scratch).first()
    assert (got.rho, got.n) == (pytest.approx(0.866025), 3)


def judd(pred, fix):
    th = sorted((p for p, f in zip(pred, fix) if f), reverse=True)
    n, k = len(pred), len(th)
    fp = [0] + [(sum(p >= t for p in pred) - i) / (n - k) for i, t in enumerate(th)] + [1]
    tp = [0] + [(i + 1) / k for i in range(k)] + [1]
    return sum((fp[i + 1] - fp[i]) * (tp[i + 1] + tp[i]) / 2 for i in range(k + 1))


def test_auc_equals_trapezoid_sum(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for m in range(5):
        size = 400 if m == 0 else 60
        pred = [rng.choice([0.0, 0.0, rng.random(), 0.5]) for _ in range(size)]
        fix = [rng.random() < 0.2 for _ in range(size)]
        want[m] = judd(pred, fix)
        rows += [(m, i // 10, i % 10, p, float(f)) for i, (p, f) in enumerate(zip(pred, fix))]
    rows += [(98, 0, i, 0.3, float(i == 0)) for i in range(4)]  # flat map
    rows += [(99, 0, i, i / 4, 0.0) for i in range(4)]  # no fixations
    df = spark.createDataFrame(rows, "map_id long, y int, x int, pred double, gt double")
    got = {r.map_id: r.auc for r in maps.auc_judd(df).collect()}
    assert got[98] is None and got[99] is None
    for m, w in want.items():
        assert got[m] == pytest.approx(w, abs=1e-12)


def test_shuffled_auc_is_pairwise_expectation(spark):
    rng = random.Random(8)
    cells = [(m, y, x, rng.choice([0.1, 0.2, rng.random()]), float(rng.random() < 0.3))
             for m in range(4) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(cells, "map_id long, y int, x int, pred double, gt double")
    got = {r.map_id: r.shuffled_auc for r in maps.shuffled_auc(df).collect()}
    at = {(m, y, x): (p, g) for m, y, x, p, g in cells}
    for m in range(4):
        pos = [p for (k, _, _), (p, g) in at.items() if k == m and g > 0]
        neg = [at[m, y, x][0] for (k, y, x), (_, g) in at.items() if k != m and g > 0]
        score = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert got[m] == pytest.approx(score)


def test_split_join_keeps_every_row(spark):
    rows = [(1, i) for i in range(700)] + [(k, k) for k in range(2, 200)]
    big = spark.createDataFrame(rows, "k long, v long")
    small = spark.createDataFrame([(k, k * 10) for k in range(1, 150)], "k long, w long")
    got = sorted(split_join(big, small, ["k"], ["v"]).collect())
    assert got == sorted(big.join(small, "k").collect())
    left = split_join(big, small, ["k"], ["v"], how="left")
    assert left.count() == len(rows)


def test_split_join_spreads_a_hot_key(spark):
    big = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(1, 5)], "k int, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = split_join(big, small, ["k"], ["v"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 4000


def test_student_t_p_values():
    # Table values of Student's t (two-sided).
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (1.984, 100, 0.05), (2.626, 100, 0.01)):
        assert study.student_t_p(t, df) == pytest.approx(p, rel=2e-3)
    assert study.student_t_p(0.0, 10) == pytest.approx(1.0)
    assert math.isnan(study.student_t_p(1.0, 0))


def test_fuzzy_match_takes_first_name(spark):
    stems = spark.createDataFrame([("img_1",), ("x-img_7-y",), ("zzz",)], "stem string")
    names = spark.createDataFrame([("img_12",), ("img_1",), ("img_7",), ("img_10",)], "name string")
    got = {r.stem: r.name for r in study.fuzzy_match(stems, names).collect()}
    assert got == {"img_1": "img_1", "x-img_7-y": "img_7"}


def test_fuzzy_match_equals_pairing_all(spark):
    """Short and long texts over few letters, so that runs repeat and most seeds find false candidates too."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12, 30]))) for _ in range(160)]
    stems, names = words[:80] + [None, "zé", "%_"], words[80:] + [None, "xzéx", "100%_"]
    want = {}
    for s in {x for x in stems if x}:
        found = [n for n in names if n and (s in n or n in s)]
        if found:
            want[s] = min(found)
    got = study.fuzzy_match(
        spark.createDataFrame([(x,) for x in stems], "stem string"), spark.createDataFrame([(x,) for x in names], "name string")
    ).collect()
    assert {r.stem: r.name for r in got} == want and len(got) == len(want) > 20
    empty = spark.createDataFrame([], "name string")
    assert study.fuzzy_match(spark.createDataFrame([("a",)], "stem string"), empty).count() == 0
