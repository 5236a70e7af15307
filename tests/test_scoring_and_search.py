import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocuspark.functions.columns import as_bool, clamp_count, parse_schedule
from ocuspark.operators import glances, norms, scoring, search

FEATURES = norms.FEATURES


def screen(spark, rows):
    base = dict.fromkeys(FEATURES, None) | {"whitespace_ratio": None, "text_density": None}
    names = ["name", *base]
    data = [(n, *[({**base, **v})[c] for c in names[1:]]) for n, v in rows.items()]
    return spark.createDataFrame(data, "name string, " + ", ".join(f"{c} double" for c in names[1:]))


def load_index(spark, rows):
    return {r.name: r.cognitive_load_index for r in scoring.load_features(screen(spark, rows)).collect()}


BLANK = {
    "edge_density": 0.0, "feature_congestion": 0.0, "interactive_element_density": 0.0,
    "layout_symmetry": 1.0, "visual_hierarchy": 1.0, "text_density": 0.0,
}


def test_blank_screen_is_light(spark):
    out = load_index(spark, {"blank": BLANK | {"whitespace_ratio": 1.0}, "full": BLANK | {"whitespace_ratio": 0.0}})
    assert out["blank"] < 0.1 < out["full"]


def test_busier_screens_load_more(spark):
    def s(edge, crowd, count, sym, order, ws):
        return dict(zip(
            ["edge_density", "feature_congestion", "interactive_element_density", "layout_symmetry",
             "visual_hierarchy", "whitespace_ratio"], (edge, crowd, count, sym, order, ws)))

    out = load_index(spark, {
        "dashboard": s(0.09, 7.0, 0.9, 0.15, 0.3, 0.15),
        "settings": s(0.035, 4.0, 0.25, 0.35, 0.45, 0.5),
        "form": s(0.02, 2.5, 0.1, 0.7, 0.85, 0.7),
    })
    assert out["dashboard"] > out["settings"] > out["form"]


def test_neutral_task_and_profile_change_nothing(spark):
    df = spark.createDataFrame(
        [("search", "medium", "medium", "known_item", "neutral"), ("?", "?", "?", "?", "?")],
        "task_type string, target_specificity string, time_pressure string, search_mode string, profile string",
    )
    for r in scoring.profile_columns(scoring.task_columns(df)).collect():
        assert abs(r.task_modifier) < 1e-9 and abs(r.profile_modifier) < 1e-9


def test_percentiles_clamp_and_interpolate(spark):
    norm = {"min": 0.0, "p5": 0.0, "p25": 1.0, "p50": 2.0, "p75": 3.0, "p95": 4.0, "max": 5.0}
    xs = [-1.0, 0.0, 0.5, 2.0, 4.5, 9.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    share = [r[0] for r in df.select(scoring.percentile_share(F.col("v"), norm)).collect()]
    assert share == pytest.approx([0.0, 0.0, 0.125, 0.5, 0.975, 1.0, 0.5])
    lit = lambda s: F.lit(norm[s])
    pct = [r[0] for r in df.na.drop().select(scoring.empirical_percentile(F.col("v"), lit)).collect()]
    assert pct == pytest.approx([0.0, 0.0, 15.0, 50.0, 97.5, 100.0])


def test_parameters(spark):
    df = spark.createDataFrame([("0",), ("-5",), (None,), ("99999",), ("100",), ("x",)], "n string")
    assert [r[0] for r in df.select(clamp_count("n")).collect()] == [1, 1, 100, 500, 100, 100]
    df = spark.createDataFrame([(" Yes",), ("on",), ("0",), (None,)], "b string")
    assert [r[0] for r in df.select(as_bool("b")).collect()] == [True, True, False, False]
    long = ",".join(str(i) for i in range(1, 52))
    df = spark.createDataFrame([("5, 1,5",), ("",), ("0,3",), ("a",), (long,)], "s string")
    got = [r[0] for r in df.select(parse_schedule("s")).collect()]
    assert got == [[1, 5], [1, 10, 100], None, None, None]


def test_coherence_rules(spark):
    df = spark.createDataFrame(
        [(0.6, 5.0, 5.0, 30.0), (0.2, 9.0, 1.0, 70.0), (None, None, None, 50.0)],
        "saliency_dispersion double, estimated_fixation_count double, mean_search_time_s double, score double",
    )
    rows = scoring.coherence(df).collect()
    assert rows[0].flags == ["saliency_fixation_mismatch", "search_time_load_mismatch"]
    assert rows[1].flags == ["concentrated_saliency_high_load"] and len(rows[1].warnings) == 1
    assert rows[2].is_coherent and rows[2].rules_checked == 0


def test_norms_of_one_value(spark):
    df = spark.createDataFrame([(2.0, float("nan"))], "a double, b double")
    rows = norms.feature_norms(df, ["a", "b"]).collect()
    assert [(r.feature, r.n, r.std, r.p95) for r in rows] == [("a", 1, 0.0, 2.0)]


def test_norms_round_trip(spark, scratch):
    df = spark.createDataFrame([(float(i), "web") for i in range(50)], "a double, category string")
    n = norms.feature_norms(df, ["a"])
    norms.write_norms(n, norms.corpus_metadata(df), f"{scratch}/norms")
    back, meta = norms.read_norms(spark, f"{scratch}/norms")
    assert norms.norms_dict(back) == norms.norms_dict(n)
    assert meta["num_images"] == 50 and meta["category_counts"] == {"web": 50}


def packed(spark, rows):
    df = spark.createDataFrame(rows, "screen_id long, element_id long, x int, y int, w int, h int, color string")
    from ocuspark.operators import layout

    return layout.pack(df.withColumns({
        "cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0,
        "area": (F.col("w") * F.col("h")).cast("long"),
    }))


def test_large_screen_in_blocks_equals_a_loop(spark):
    """One screen of many blocks and one that fits a block, a missing colour and copies of a box, beside plain sums."""
    rng = random.Random(11)
    rows = []
    for screen, n in [(1, 700), (2, 40), (3, 2)]:
        for i in range(n):
            rows.append((screen, i, rng.randrange(900), rng.randrange(600), rng.randrange(1, 90), rng.randrange(1, 90), rng.choice(["red", "blue", None])))
    rows += [(1, 700, *rows[0][2:]), (1, 701, *rows[0][2:])]
    want = {}
    for screen in (1, 2, 3):
        mine = [(i, x + w / 2, y + h / 2, w * h, c) for s, i, x, y, w, h, c in rows if s == screen]
        raw = {}
        for i, cx, cy, area, c in mine:
            raw[i] = sum(
                ((0 if c is not None and c == c2 else 1) + abs(area - a2) / (area + a2)) / math.sqrt(max(math.hypot(cx - x2, cy - y2), 1))
                for j, x2, y2, a2, c2 in mine if j != i
            )
        want |= {(screen, i): v / max(raw.values()) for i, v in raw.items()}
    for block in (64, 10_000):
        out = search.distinctiveness(packed(spark, rows), block=block).collect()
        got = {(r.screen_id, r.element_id): r.distinctiveness for r in out}
        assert len(out) == len(want) and got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_target_that_is_no_element_gives_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 10, "red"), (1, 1, 30, "red"), (2, 0, 5, None)], "screen_id long, element_id long, area long, color string")
    aims = spark.createDataFrame([(1, 1), (1, 9), (2, 0), (3, 0)], "screen_id long, target_id long")
    got = {(r.screen_id, r.target_id, r.element_id): r.similarity for r in search.target_similarity(df, aims).collect()}
    assert got == {(1, 1, 0): 0.75, (1, 1, 1): 1.0, (2, 0, 0): 0.5}


def test_unique_colour_stands_out(spark):
    rows = [(1, i, 100 * (i % 6), 100 * (i // 6), 50, 30, "red" if i == 5 else "gray") for i in range(24)]
    rows.append((2, 0, 0, 0, 10, 10, "gray"))
    out = search.distinctiveness(packed(spark, rows)).collect()
    best = max((r for r in out if r.screen_id == 1), key=lambda r: r.distinctiveness)
    assert (best.element_id, best.distinctiveness) == (5, 1.0)
    assert [r.distinctiveness for r in out if r.screen_id == 2] == [1.0]


def loop_glances(steps):
    out, cur = [], 0.0
    for s in steps:
        if cur and cur + s > 1.5:
            out, cur = [*out, cur], s
        else:
            cur += s
    return [*out, cur] if cur else out


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_glances_equal_loop(spark, block_rows):
    rng = random.Random(11)
    scans = {k: [rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, 1.5, 2.4, rng.random()]) for _ in range(n)]
             for k, n in enumerate((150, 40, 7, 1, 3))}
    scans[90] = [0.01] * 60
    scans[91] = [0.0, 0.0]
    rows = [(k, i + 1, s, False) for k, v in scans.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "scan_id long, step_ord long, step_time_s double, is_target boolean")
    for r in search.glance_metrics(df, block_rows=block_rows).collect():
        want = loop_glances([s for s in scans[r.scan_id] if s > 0])
        assert r.n_glances == len(want)
        assert r.max_single_glance_s == pytest.approx(max(want, default=0), abs=1e-3)
        assert r.total_eyes_off_road_s == pytest.approx(sum(want), abs=1e-3)
        assert r.compliant == (max(want, default=0) <= 2 and sum(want) <= 12 + 1e-9)


@pytest.mark.parametrize(("block_rows", "fan"), [(1, 2), (3, 2), (4, 3), (1000, 32)])
def test_glance_list_equals_loop(spark, block_rows, fan):
    """Scans cut into blocks and trees of several levels; tiny steps make glances longer than blocks and than whole trees of blocks."""
    rng = random.Random(5)
    scans = {k: [rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, 1.5, 2.4, rng.random()]) for _ in range(n)] for k, n in enumerate((90, 33, 8, 1))}
    scans[70] = [0.01] * 400
    scans[71] = [0.0, 0.0]
    scans[72] = [0.1] * 151 + [3.0] * 5 + [0.3] * 20
    rows = [(k, i + 1, s, False) for k, v in scans.items() for i, s in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scan_id long, step_ord long, step_time_s double, is_target boolean")
    got = {(r.scan_id, r.glance): (r.start_ord, r.n_steps, r.time_s) for r in search.glance_list(df, block_rows=block_rows, digits=12, fan=fan).collect()}
    want = {}
    for k, v in scans.items():
        current, number = 0.0, 0
        for i, s in enumerate(v, 1):
            if s <= 0:
                continue
            if current == 0.0 or current + s > 1.5:
                number += 1
                start, size, current = i, 1, s
            else:
                size, current = size + 1, current + s
            want[k, number] = (start, size, round(current, 12))
    assert got == want


def test_one_long_scan_is_spread(spark):
    """A scan with half of all rows: no block or fold holds more than its share."""
    rows = [(1, i, 0.001 * (i % 7), False) for i in range(1, 8001)] + [(s, i, 0.4, False) for s in range(2, 402) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "scan_id long, step_ord long, step_time_s double, is_target boolean")
    tree = glances.Tree(df, 1.5, 100, 4)
    assert len(tree.levels) == 5 and tree.blocks.select(F.max(F.size("times"))).first()[0] <= 100
    assert [level.filter("scan_id = 1").count() for level in tree.levels] == [80, 20, 5, 2, 1]
    want = loop_glances([r[2] for r in rows if r[0] == 1 and r[2] > 0])
    found = glances.glance_list(tree, 9).filter("scan_id = 1").orderBy("glance").collect()
    assert [r.time_s for r in found] == pytest.approx(want) and sum(r.n_steps for r in found) == sum(r[2] > 0 for r in rows if r[0] == 1)


def test_median_trial(spark):
    rows = [(1, 1, 1, t, f, 0.5) for t, f in enumerate([9, 3, 3, 7, 3], 1)] + [(2, 1, 1, 1, 4, 0.5)]
    df = spark.createDataFrame(
        rows, "screen_id long, target_id int, n_exposures int, trial long, n_fixations int, total_time_s double")
    got = {r.screen_id: r.trial for r in search.median_trial(df).collect()}
    assert got == {1: 5, 2: 1}


def test_transfer_bounds(spark):
    curve = spark.createDataFrame([(1, 4.0), (10, 3.0), (100, 2.0)], "n_exposures int, mean_search_time_s double")
    products = spark.createDataFrame([(1, 10, 1.0), (2, 10, 0.0)], "product_id long, n_screens int, consistency_score double")
    rows = {r.product_id: r for r in search.product_learning(products, curve).filter("total_uses = 100").collect()}
    assert rows[1].steady_state_time_s == pytest.approx(2.0) and rows[1].benefit == pytest.approx(1 / 3)
    assert rows[2].steady_state_time_s == pytest.approx(3.0) and rows[2].benefit == 0.0
    assert math.isclose(rows[2].effective_exposures, 10.0)


def test_difficulty_bands(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (5.0,)], "s double")
    got = [r[0] for r in df.select(search.difficulty(F.col("s"))).collect()]
    assert got == ["easy", "moderate", "difficult", "very_hard"]


def test_quantile_rule_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=101)
    df = spark.createDataFrame([(float(x),) for x in v], "a double")
    r = norms.feature_norms(df, ["a"]).first()
    assert [r.p5, r.p50, r.p95] == pytest.approx(list(np.percentile(v, [5, 50, 95])))
    assert r["std"] == pytest.approx(v.std(ddof=1))


def test_median_trial_with_many_fixations(spark):
    """Counts from 2^22 on and equal counts are told apart by the trial number."""
    rows = [(1, 1, 0, t, 2**23) for t in range(3)] + [(2, 1, 0, t, n) for t, n in enumerate([5, 2**40, 2**40 + 1, 2**40, 9])]
    df = spark.createDataFrame(rows, "screen_id long, target_id long, n_exposures long, trial long, n_fixations long")
    got = {r.screen_id: r.trial for r in search.median_trial(df).collect()}
    assert got == {1: 1, 2: 1} and search.median_trial(df).count() == 2
