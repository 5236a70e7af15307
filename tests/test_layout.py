import random

import pytest
from pyspark.sql import functions as F

from ocuspark.operators import layout, tiles
from ocuspark.operators.tiles import tile_coverage

ELEMENTS = "screen_id long, element_id long, x int, y int, w int, h int, color string"
SCREENS = "screen_id long, product_id long, screen_ord long, img_w int, img_h int"


def elements(spark, rows):
    df = spark.createDataFrame(rows, ELEMENTS)
    return df.withColumns(
        {
            "cx": F.col("x") + F.col("w") / 2.0,
            "cy": F.col("y") + F.col("h") / 2.0,
            "area": (F.col("w") * F.col("h")).cast("long"),
        }
    )


def grid(spark, boxes, w=100, h=100):
    e = elements(spark, [(1, i, *b, "gray") for i, b in enumerate(boxes)])
    s = spark.createDataFrame([(1, 1, 1, w, h)], SCREENS)
    return {(r.row, r.col): r.occupancy for r in layout.occupancy(e, s).collect()}


def test_one_box_fills_its_cell(spark):
    assert grid(spark, [(0, 0, 10, 10)]) == {(0, 0): 1.0}


def test_overlap_counts_once(spark):
    cells = grid(spark, [(0, 0, 8, 8), (2, 2, 8, 8)])
    assert cells[0, 0] < 1 and max(cells.values()) <= 1
    assert grid(spark, [(0, 0, 7, 7)]) == grid(spark, [(0, 0, 7, 7), (0, 0, 7, 7)])


def test_tile_coverage_equals_raster(spark):
    rng = random.Random(2)
    rects, cells = [], set()
    for k in range(60):
        r, c = rng.randrange(150), rng.randrange(200)
        r1, c1 = r + rng.randrange(0, 60), c + rng.randrange(0, 90)
        rects.append((1, r, r1, c, c1))
        cells |= {(i, j) for i in range(r, r1) for j in range(c, c1)}
    df = spark.createDataFrame(rects, "k long, r0 int, r1 int, c0 int, c1 int")
    for th, tw in ((20, 20), (16, 60), (7, 5), (3, 62)):
        got = tile_coverage(df, ["k"], th, tw).agg(F.sum("covered")).first()[0]
        assert got == len(cells)


def loop_nms(boxes, limit=80):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[3] * b[4], b[0])):
        def iou(a):
            w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
            h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
            i = max(w, 0) * max(h, 0)
            return i / max(a[3] * a[4] + b[3] * b[4] - i, 1)

        if len(kept) < limit and all(iou(a) <= 0.5 for a in kept):
            kept.append(b)
    return {b[0] for b in kept}


@pytest.mark.parametrize("batch", [5, 512])
def test_suppression_equals_loop(spark, batch):
    """A small batch forces several rounds; screen 1 holds most boxes and copies."""
    rng = random.Random(7)
    screens, rows = {}, []
    for s, n in ((1, 260), (2, 30), (3, 4)):
        boxes = [
            (i, rng.randrange(0, 120, 6), rng.randrange(0, 60, 6), rng.choice([20, 30, 40]), rng.choice([20, 30]))
            for i in range(n)
        ]
        boxes += [(n + i, *boxes[0][1:]) for i in range(20)]
        screens[s] = boxes
        rows += [(s, *b) for b in boxes]
    df = spark.createDataFrame(rows, "screen_id long, element_id long, x int, y int, w int, h int")
    got = {}
    for r in layout.suppress_overlaps(df, batch=batch).collect():
        got.setdefault(r.screen_id, set()).add(r.element_id)
    assert got == {s: loop_nms(b) for s, b in screens.items()}


def six(spark, moved_second=False):
    """Six boxes on two screens: a red logo that stays and five grey boxes."""
    rows = []
    for s in (1, 2):
        for i in range(6):
            x = 900 if moved_second and s == 2 and i > 0 else 100
            rows.append((s, i, x, 150 * i, 60, 40, "gray" if i else "red"))
    screens = [(1, 7, 1, 1000, 1000), (2, 7, 2, 1000, 1000)]
    return elements(spark, rows), spark.createDataFrame(screens, SCREENS)


def test_identical_screens_are_consistent(spark):
    r = layout.screen_consistency(*six(spark)).first()
    assert (r.consistency_score, r.match_coverage, r.mean_element_displacement) == (1.0, 1.0, 0.0)


def test_one_lucky_match_is_not_enough(spark):
    r = layout.screen_consistency(*six(spark, moved_second=True)).first()
    assert r.match_coverage < 0.5 and r.consistency_score < 1


def test_matches_are_computed_once(spark):
    """Neither a filter on them nor several uses repeat the greedy fold in the plan."""
    e, s = six(spark)
    pairs = layout.consecutive_pairs(layout.pack(e), s)
    m = layout.match_greedily(layout.candidate_matches(pairs)).filter(F.size("matched") > 0)
    total = F.aggregate("matched", F.lit(0.0), lambda t, e: t + e["distance"])
    out = m.select(F.size("matched").alias("n"), total.alias("total"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") == 1 and plan.count("flatten(") == 1
    assert [tuple(r) for r in out.collect()] == [(6, 0.0)]


def test_single_screen_is_trivially_consistent(spark):
    e, s = six(spark)
    r = layout.screen_consistency(e.filter("screen_id = 1"), s.filter("screen_id = 1")).first()
    assert (r.consistency_score, r.mean_element_displacement) == (1.0, None)


def test_target_resolution_order(spark):
    e = elements(spark, [(1, 0, 0, 0, 10, 10, "red"), (1, 1, 5, 5, 10, 10, "red"), (1, 2, 80, 80, 4, 4, "red")])
    req = spark.createDataFrame(
        [(1, 1, 2, 7, 7), (2, 1, None, 7, 7), (3, 1, None, 70, 70), (4, 1, 9, 7, 7), (5, 1, None, None, 1)],
        "request_id long, screen_id long, target_id long, target_x int, target_y int",
    )
    got = {r.request_id: r.resolved_id for r in layout.resolve_target(req, layout.pack(e)).collect()}
    assert got == {1: 2, 2: 0, 3: 2, 4: None, 5: None}


def test_words_split_on_unicode_blanks(spark):
    df = spark.createDataFrame([("a b c　d\te\n\nf",), ("   ",), ("",)], "text string")
    assert [r[0] for r in df.select(layout.word_count("text")).collect()] == [6, 0, 0]


@pytest.mark.parametrize("direct", [3, 80])
def test_union_area_equals_raster(spark, direct):
    """A low limit sends the crowded screen through the tile masks."""
    rng = random.Random(5)
    rows, want = [], {}
    for s, n in ((1, 90), (2, 3), (3, 1)):
        cells = set()
        for _ in range(n):
            r, c = rng.randrange(100), rng.randrange(120)
            r1, c1 = r + rng.randrange(0, 30), c + rng.randrange(0, 40)
            rows.append((s, r, r1, c, c1))
            cells |= {(i, j) for i in range(r, r1) for j in range(c, c1)}
        want[s] = len(cells)
    df = spark.createDataFrame(rows, "screen_id long, r0 int, r1 int, c0 int, c1 int")
    got = {r.screen_id: r.covered for r in layout.union_area(df, direct).collect()}
    assert {s: n for s, n in want.items() if n} == got


def test_packed_screens_keep_every_element(spark):
    """80 large boxes and one small region: the region resolves, and rates the others."""
    from ocuspark.operators import search

    boxes = [(1, i, 20 * i, 20 * i, 30, 30, "red") for i in range(80)] + [(1, 80, 5000, 5000, 2, 2, "blue")]
    packed = layout.pack(elements(spark, boxes))
    assert packed.selectExpr("size(elements)").first()[0] == 81
    req = spark.createDataFrame(
        [(1, 1, 80, None, None), (2, 1, None, 5001, 5001)], "request_id long, screen_id long, target_id long, target_x int, target_y int"
    )
    assert {r.resolved_id for r in layout.resolve_target(req, packed).collect()} == {80}
    target = spark.createDataFrame([(1, 80)], "screen_id long, target_id long")
    assert search.target_similarity(packed, target).count() == 81
    look = spark.createDataFrame([(1, 5001, 5001, 40.0)], "screen_id long, x int, y int, duration_ms double")
    assert [r.element_id for r in layout.aoi_hits(look, packed).collect()] == [80]
    with pytest.raises(Exception, match="more than 10 elements"):
        layout.pack(elements(spark, boxes), most=10).collect()


def test_points_on_a_screen_of_many_elements(spark):
    """Containment and nearest centres beside a loop; the second screen has more elements than a packed row may hold."""
    rng = random.Random(6)
    few = [(1, i, rng.randrange(900), rng.randrange(600), rng.randrange(1, 200), rng.randrange(1, 150)) for i in range(30)]
    many = [(2, i, 20 * (i % 130), 20 * (i // 130), 8, 8) for i in range(12_000)]
    frame = spark.createDataFrame(few + many, "screen_id long, element_id long, x int, y int, w int, h int")
    frame = frame.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    spots = [(n, rng.choice([1, 1, 2, 3]), rng.choice([None, None, None, 4, 99]), float(rng.randrange(-300, 3000)), float(rng.randrange(-100, 2000))) for n in range(120)]
    spots += [(200, 1, None, None, 5.0), (201, 1, None, float(few[0][2]), float(few[0][3])), (202, 2, None, 50_000.0, 50_000.0)]
    asked = spark.createDataFrame(spots, "request_id long, screen_id long, target_id long, target_x double, target_y double")

    def inside(s, px, py):
        return [] if px is None else [e for t, e, x, y, w, h in few + many if t == s and x <= px <= x + w and y <= py <= y + h]

    want = {}
    for n, s, target, px, py in spots:
        own = [(((x + w / 2) - px) ** 2 + ((y + h / 2) - py) ** 2, e) for t, e, x, y, w, h in few + many if t == s] if px is not None else []
        if target is not None:
            want[n] = target if any(t == s and e == target for t, e, *_ in few + many) else None
        else:
            want[n] = min(inside(s, px, py), default=min(own)[1] if own else None)
    assert {r.request_id: r.resolved_id for r in layout.resolve_target(asked, frame).collect()} == want
    hits = layout.aoi_hits(asked.withColumnsRenamed({"target_x": "x", "target_y": "y"}), frame).collect()
    assert sorted((r.request_id, r.element_id is None, r.element_id or 0) for r in hits) == sorted(
        (n, e is None, e or 0) for n, s, _, px, py in spots for e in (inside(s, px, py) or [None])
    )
    first = layout.hit_first(asked, frame, "target_x", "target_y").collect()
    assert {r.request_id: r.element_id for r in first} == {n: min(inside(s, px, py), default=None) for n, s, _, px, py in spots}


def test_only_screens_with_points_are_cut_into_tiles(spark, monkeypatch):
    boxes = [(s, e, 10 * e, 0, 30, 30, 10 * e + 15.0, 15.0) for s in range(40) for e in range(3)]
    elements = spark.createDataFrame(boxes, "screen_id long, element_id long, x int, y int, w int, h int, cx double, cy double")
    requests = spark.createDataFrame([(1, 5, None, 12.0, 3.0), (2, 9, 2, 0.0, 0.0), (3, 5, None, 400.0, 300.0), (4, 77, 1, 1.0, 1.0)], "request_id long, screen_id long, target_id long, target_x double, target_y double")
    dealt, join = [], layout.split_join

    def watched(big, small, *rest, **named):
        dealt.append(small.select("screen_id").distinct())
        return join(big, small, *rest, **named)

    monkeypatch.setattr(layout, "split_join", watched)
    found = layout.resolve_target(requests, elements).collect()
    assert {r.request_id: r.resolved_id for r in found} == {1: 0, 2: 2, 3: 2, 4: None}
    assert all({r.screen_id for r in d.collect()} <= {5, 9} for d in dealt)


def test_rectangles_are_shuffled_before_they_become_masks(spark):
    rng = random.Random(6)
    rows = [(0 if i < 300 else rng.randrange(1, 60), *sorted(rng.sample(range(90), 2)), *sorted(rng.sample(range(90), 2))) for i in range(600)]
    rects = spark.createDataFrame(rows, "screen_id long, r0 int, r1 int, c0 int, c1 int")
    out = tiles.tile_coverage(rects, ["screen_id"], 20, 20)
    want = {}
    for s, r0, r1, c0, c1 in rows:
        for r in range(r0, r1):
            for c in range(c0, c1):
                want.setdefault((s, r // 20, c // 20), set()).add((r, c))
    assert {(r.screen_id, r.tile_row, r.tile_col): r.covered for r in out.collect()} == {k: len(v) for k, v in want.items()}
    assert "RepartitionByExpression [screen_id" in out._jdf.queryExecution().optimizedPlan().toString()
