"""Findings of round 4: what queries shuffle and write, and that the results stay."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ocuspark.operators import layout, search
from ocuspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def some_screens(spark, products=5, seed=3):
    """Screens with and without elements, boxes that overlap, repeat and leave the image; one product is null."""
    rng = random.Random(seed)
    rows, screens, s = [], [], 0
    for p in [*range(products), None]:
        for order in range(1, rng.randrange(2, 12)):
            s += 1
            screens.append((s, p, order, 300, 200))
            for e in range(rng.choice([0, 1, 4, 7])):
                box = (rng.randrange(-30, 320, 5), rng.randrange(-30, 220, 5), rng.randrange(0, 120, 5), rng.randrange(0, 90, 5))
                rows += [(s, e, *box, 10.0 * (e % 3), 0.9, 0.9, 4.0)]
    elements = spark.createDataFrame(rows, "screen_id long, element_id long, x int, y int, w int, h int, hue_deg double, sat double, val double, contrast_ratio double")
    return layout.describe_elements(elements), spark.createDataFrame(screens, "screen_id long, product_id long, screen_ord int, img_w int, img_h int")


@pytest.mark.parametrize("run", [3, 1024])
def test_consistency_equals_its_parts(spark, run):
    """dealt once by product, or in runs of its screens, as from ``occupancy`` and one pair of screens after the other."""
    elements, screens = some_screens(spark)
    cells = layout.cell_instability(layout.occupancy(elements, screens), screens)
    want = {r.product_id: (r.n_screens, round(r.occupancy_consistency, 4)) for r in layout.occupancy_consistency(cells, screens).collect()}
    pairs = layout.consecutive_pairs(layout.pack(elements), screens)
    moved = {}
    for r in layout.match_greedily(layout.candidate_matches(pairs)).select("product_id", "matched").collect():
        moved.setdefault(r.product_id, []).extend(m["distance"] for m in r.matched)
    got = {r.product_id: r for r in layout.screen_consistency(elements, screens, run).collect()}
    assert {p: (r.n_screens, r.occupancy_consistency) for p, r in got.items()} == want
    assert None in got and got[None].mean_element_displacement is None
    for p, r in got.items():
        far = moved.get(p) or []
        assert r.max_element_displacement == (round(max(far), 4) if far else None)
        assert r.mean_element_displacement == (pytest.approx(sum(far) / len(far), abs=1e-4) if far else None)


@tables
def test_consistency_shuffles_elements_twice(spark):
    """lineitem and orders are read once, elements dealt by screen and, packed, by product."""
    found = plan(spark, "layout_screen_consistency")
    assert found.count("FileScan parquet") == 2
    assert found.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("block", [3, 256])
def test_priority_to_last_equals_its_terms(spark, block):
    """screens in one row each, and with a low limit some spread over rows, as the join of the three terms."""
    elements, _ = some_screens(spark, seed=4)
    saliency = elements.filter("element_id % 2 = 0 AND screen_id % 3 > 0").selectExpr("screen_id", "element_id", "(element_id + 1) / 8e0 as saliency")
    targets = elements.groupBy("screen_id").agg(F.max("element_id").alias("target_id"))
    similar = search.target_similarity(elements, targets).drop("target_id")
    want = {(r.screen_id, r.element_id): r.priority for r in search.attention_priority(search.distinctiveness(elements), saliency, similar).collect()}
    got = search.priority_to_last(elements, saliency, block).collect()
    assert len(got) == len(want) > 0
    assert all(r.priority == pytest.approx(want[r.screen_id, r.element_id], abs=1e-9) for r in got)


@tables
def test_priority_shuffles_elements_once(spark):
    """the elements are numbered once and joined with saliencies by screen."""
    found = plan(spark, "search_attention_priority")
    assert found.count("lineitem.parquet") == 1 and found.count("row_number(") == 1


def test_texts_of_the_longest_elements(spark):
    """a text of an element outside the few, of low confidence or blank is not shown; the others in box order."""
    elements = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 20, 0, 10, 10), (2, 1, 0, 0, 10, 10)], "screen_id long, element_id long, x int, y int, w int, h int")
    boxes = [
        (5, 1, 2.0, 2.0, " b c ", 0.9), (3, 1, 3.0, 2.0, "a\n", 0.9), (4, 1, 3.0, 3.0, "low", 0.1), (6, 1, 4.0, 4.0, "  ", 0.9),
        (7, 1, 25.0, 5.0, "one", 0.9), (8, 2, 90.0, 5.0, "outside", 0.9), (9, 2, None, 5.0, "nowhere", 0.9), (10, 3, 1.0, 1.0, "no screen", 0.9),
    ]
    boxes = spark.createDataFrame(boxes, "box_id long, screen_id long, cx double, cy double, text string, conf double")
    owned = layout.owned_boxes(boxes, elements)
    texts = layout.longest_texts(layout.reading_times(owned), k=1)
    out = layout.with_text(texts, owned, boxes.select("box_id", "text", "conf")).collect()
    assert [(r.screen_id, r.element_id, r.n_words, r["rank"], r.text) for r in out] == [(1, 1, 3, 1, "a b c")]
    counted = boxes.withColumn("words", layout.word_count("text")).drop("text")
    assert sorted(layout.element_texts(counted, elements).collect()) == sorted(layout.element_texts(boxes, elements).collect())


@tables
def test_longest_texts_read_each_text_once_more(spark):
    """what follows the owned boxes reads no elements, and the texts once."""
    found = plan(spark, "layout_longest_texts_with_text")
    assert found.count("lineitem.parquet") == 0 and found.count("FileScan parquet") == 1
