"""Element tables: filters, overlap suppression, occupancy, matching, hits.

A screen's detected elements are, by definition of the detector, the 80 largest
boxes left after overlap suppression. Pairwise operators therefore work on
*packed screens* (one row per screen with an array of at most 80 structs) and
use array functions, so no pair rows are shuffled and nothing leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.functions.columns import clip
from ocuspark.operators.lineage import cut
from ocuspark.operators.skew import split_join
from ocuspark.operators.tiles import tile_coverage

# ---- Fixed values -------------------------------------------------------
MIN_AREA, MAX_AREA_SHARE, MIN_ASPECT, MAX_ASPECT = 400, 0.5, 0.05, 20.0
MAX_ELEMENTS, NMS_IOU = 80, 0.5
CONTRAST_MIN = 3.0
WORDS_PER_MINUTE, MIN_TEXT_CONFIDENCE = 238.0, 0.3
GRID, SUPERSAMPLE = 10, 20
W_POSITION, W_SIZE, W_COLOR, MAX_COST = 1.0, 0.3, 0.3, 0.35
# width cm, height cm, viewing distance cm
DISPLAY_PRESETS = {
    "phone": (7.0, 15.0, 30.0),
    "laptop": (30.9, 17.4, 50.0),
    "desktop": (37.0, 23.0, 60.0),
    "ivi_8": (17.7, 10.0, 70.0),
    "ivi_10": (22.7, 12.7, 72.0),
    "ivi_12": (27.2, 15.3, 75.0),
    "ivi_15": (33.2, 18.7, 75.0),
    "cluster": (27.2, 15.3, 80.0),
    "hud": (30.0, 12.0, 220.0),
}
VERDICTS = [
    "highly consistent layout across screens",
    "moderately consistent layout",
    "low layout consistency - recurring controls likely move between screens",
]
# Runs of non-blank characters; blank as in Unicode text splitting.
WORD = (
    r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
EDGES = rf"^[{WORD[2:-2]}]+|[{WORD[2:-2]}]+$"
# -------------------------------------------------------------------------


def color_category(hue: Column, sat: Column, val: Column) -> Column:
    grey = (
        F.when(val < 0.3, F.lit("black")).when(val > 0.8, F.lit("white")).otherwise(F.lit("gray"))
    )
    return (
        F.when(sat < 0.15, grey)
        .when((hue < 15) | (hue >= 345), F.lit("red"))
        .when(hue < 45, F.lit("orange"))
        .when(hue < 75, F.lit("yellow"))
        .when(hue < 165, F.lit("green"))
        .when(hue < 195, F.lit("cyan"))
        .when(hue < 270, F.lit("blue"))
        .otherwise(F.lit("purple"))
    )


def describe_elements(df: DataFrame) -> DataFrame:
    """Add centre, area, colour category and the contrast pass flag."""
    return df.withColumns(
        {
            "cx": F.col("x") + F.col("w") / 2.0,
            "cy": F.col("y") + F.col("h") / 2.0,
            "area": (F.col("w") * F.col("h")).cast("bigint"),
            "color": color_category(F.col("hue_deg"), F.col("sat"), F.col("val")),
            "contrast_pass": F.col("contrast_ratio") >= CONTRAST_MIN,
        }
    )


def candidate_boxes(df: DataFrame, img_w: str = "img_w", img_h: str = "img_h") -> DataFrame:
    """Plausible element boxes by area, share of the image and aspect ratio."""
    area = F.col("w").cast("bigint") * F.col("h")
    aspect = F.col("w") / F.greatest(F.col("h"), F.lit(1))
    return df.filter(
        (area >= MIN_AREA)
        & (area <= MAX_AREA_SHARE * F.col(img_w).cast("double") * F.col(img_h))
        & aspect.between(MIN_ASPECT, MAX_ASPECT)
    )


def largest_elements(df: DataFrame, k: int = MAX_ELEMENTS) -> DataFrame:
    """The k largest boxes of every screen (ties: lower element id)."""
    w = Window.partitionBy("screen_id").orderBy(F.desc("area"), "element_id")
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def _iou(a: Column, b: Column) -> Column:
    iw = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    ih = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    zero = F.lit(0).cast("bigint")
    inter = F.greatest(iw.cast("bigint"), zero) * F.greatest(ih.cast("bigint"), zero)
    union = a["area"] + b["area"] - inter
    return inter / F.greatest(union, F.lit(1).cast("bigint"))


def _keep_greedily(kept: Column, boxes: Column, limit: int) -> Column:
    """Fold the ordered boxes into the kept ones, dropping those that overlap."""
    return F.aggregate(
        boxes,
        kept,
        lambda acc, b: F.when(
            (F.size(acc) >= limit) | F.exists(acc, lambda k: _iou(k, b) > NMS_IOU), acc
        ).otherwise(F.concat(acc, F.array(b))),
    )


def suppress_overlaps(boxes: DataFrame, limit: int = MAX_ELEMENTS, batch: int = 512) -> DataFrame:
    """Greedy overlap suppression, largest first, keeping the ``limit`` largest.

    Exact for any number of boxes: each round takes the ``batch`` largest open
    boxes of a screen (a per-group limit, applied before the shuffle), folds
    them into the kept ones, and removes what is done or suppressed. A round
    keeps at least one box per open screen; ordinary screens need one round.
    """
    body = F.struct(
        (-F.col("area")).alias("neg_area"), "element_id", "x", "y", "w", "h", "area"
    )
    # Equal boxes overlap fully: only the first copy can survive.
    first = (
        boxes.groupBy("screen_id", "x", "y", "w", "h")
        .agg(F.min("element_id").alias("element_id"))
        .withColumn("area", F.col("w").cast("bigint") * F.col("h"))
    )
    order = Window.partitionBy("screen_id").orderBy(F.desc("area"), "element_id")
    kept, open_boxes = None, first
    while True:
        top = open_boxes.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= batch)
        packed = top.groupBy("screen_id").agg(
            F.array_sort(F.collect_list(body)).alias("_batch"), F.count(F.lit(1)).alias("_n")
        )
        if kept is None:
            state = packed.withColumn("kept", F.slice("_batch", 1, 0))
        else:
            state = kept.drop("_last", "_n").join(packed, "screen_id", "full").withColumns(
                {
                    "kept": F.coalesce("kept", F.slice("_batch", 1, 0)),
                    "_batch": F.coalesce("_batch", F.slice("kept", 1, 0)),
                }
            )
        kept = cut(
            state.select(
                "screen_id",
                _keep_greedily(F.col("kept"), F.col("_batch"), limit).alias("kept"),
                F.element_at("_batch", -1).alias("_last") if kept is None else
                F.try_element_at("_batch", F.lit(-1)).alias("_last"),
                F.coalesce("_n", F.lit(0)).alias("_n"),
            )
        )
        more = kept.filter((F.col("_n") == batch) & (F.size("kept") < limit))
        if more.isEmpty():
            break
        later = (-F.col("area") > F.col("_last.neg_area")) | (
            (F.col("area") == F.col("_last.area"))
            & (F.col("element_id") > F.col("_last.element_id"))
        )
        open_boxes = cut(
            split_join(open_boxes, more.select("screen_id", "kept", "_last"), ["screen_id"])
            .filter(later & ~F.exists("kept", lambda k: _iou(k, body) > NMS_IOU))
            .select("screen_id", "x", "y", "w", "h", "element_id", "area")
        )
    return kept.select("screen_id", F.explode("kept").alias("_e")).select(
        "screen_id", "_e.element_id"
    )


def detect(candidates: DataFrame) -> DataFrame:
    """Filter, suppress and cap: the element table the other operators expect."""
    described = describe_elements(candidate_boxes(candidates))
    return described.join(suppress_overlaps(described), ["screen_id", "element_id"], "left_semi")


MOST_PACKED = 10_000  # elements of one screen held in one row


PACKED = ["x", "y", "w", "h", "cx", "cy", "area", "color"]
MATCHED = ["w", "h", "cx", "cy", "color"]  # what matching reads of an element


def pack(elements: DataFrame, *extra: str, most: int = MOST_PACKED, fields: Sequence[str] = PACKED) -> DataFrame:
    """One row per screen with all its elements in id order.

    The cap on detected elements belongs to ``detect``; what a user adds later
    stays. A table with over ``most`` elements for one screen raises an error.
    """
    fields = ["element_id", *fields, *extra]
    rows = elements.groupBy("screen_id").agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("elements")
    )
    message = F.concat(F.lit(f"more than {most} elements on screen "), F.col("screen_id").cast("string"))
    fine = F.when(F.col("_n") <= most, F.col("elements")).otherwise(F.raise_error(message))
    return rows.select("screen_id", fine.alias("elements"))


def _inside(e: Column, px: Column, py: Column) -> Column:
    return px.between(e["x"], e["x"] + e["w"]) & py.between(e["y"], e["y"] + e["h"])


POINT_TILE = 64  # pixels


def flat(elements: DataFrame) -> DataFrame:
    """Elements one per row; a table of packed screens is opened."""
    return elements.selectExpr("screen_id", "inline(elements)") if "elements" in elements.columns else elements


def _of_screens(elements: DataFrame, points: DataFrame) -> DataFrame:
    """The elements of screens that have a point; no others can answer, so only these are cut into tiles."""
    return elements.join(points.select("screen_id").distinct(), "screen_id", "left_semi")


def points_inside(points: DataFrame, elements: DataFrame, x: str, y: str) -> DataFrame:
    """screen_id, _x, _y, element_id: every element whose box (borders included) contains a point, each distinct point once.

    Points and elements meet in tiles of POINT_TILE pixels, so a point sees the
    elements near it only, however many its screen has; crowded tiles are split.
    """
    spots = points.select("screen_id", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
    spots = spots.filter("_x IS NOT NULL AND _y IS NOT NULL").withColumns({"_tx": F.floor(F.col("_x") / POINT_TILE), "_ty": F.floor(F.col("_y") / POINT_TILE)})

    def tiles(low: Column, size: str) -> Column:
        return F.explode(F.sequence(F.floor(low / POINT_TILE), F.floor((low + F.col(size)) / POINT_TILE)))

    asked = _of_screens(flat(elements).select("screen_id", "element_id", "x", "y", "w", "h"), points)
    boxes = asked.withColumn("_tx", tiles(F.col("x"), "w")).withColumn("_ty", tiles(F.col("y"), "h"))
    met = split_join(spots, boxes, ["screen_id", "_tx", "_ty"], spread=["_x", "_y"])
    hit = F.col("_x").between(F.col("x"), F.col("x") + F.col("w")) & F.col("_y").between(F.col("y"), F.col("y") + F.col("h"))
    return met.filter(hit).select("screen_id", "_x", "_y", "element_id")


def _with_spots(points: DataFrame, found: DataFrame, x: str, y: str) -> DataFrame:
    """Every row of points beside the rows found for its spot, nulls where there is none."""
    keyed = points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    return split_join(keyed, found, ["screen_id", "_x", "_y"], how="left").drop("_x", "_y")


def hit_first(points: DataFrame, elements: DataFrame, x: str = "cx", y: str = "cy") -> DataFrame:
    """First element (id order) whose box contains the point; null if none."""
    first = points_inside(points, elements, x, y).groupBy("screen_id", "_x", "_y").agg(F.min("element_id").alias("element_id"))
    return _with_spots(points, first, x, y)


def nearest_centres(points: DataFrame, elements: DataFrame, x: str, y: str) -> DataFrame:
    """screen_id, _x, _y, element_id: the element with the nearest centre (ties: smallest id) of each distinct point.

    Rounds over tiles: a point looks at the three by three tiles around it. A
    centre no further than a tile's side is the nearest, as all others lie
    further; points without one go on with tiles twice as wide.
    """
    spots = points.select("screen_id", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
    asked = _of_screens(flat(elements), spots)
    centres = cut(asked.select("screen_id", "element_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")))
    left = cut(spots.join(centres.select("screen_id").distinct(), "screen_id", "left_semi").filter("_x IS NOT NULL AND _y IS NOT NULL"))
    done, side = [], float(POINT_TILE)
    while not left.isEmpty():
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        around_spots = left.withColumn("_i", around).withColumn("_j", around).select(
            "screen_id", "_x", "_y", (F.floor(F.col("_x") / side) + F.col("_i")).alias("_tx"), (F.floor(F.col("_y") / side) + F.col("_j")).alias("_ty")
        )
        dealt = centres.withColumns({"_tx": F.floor(F.col("cx") / side), "_ty": F.floor(F.col("cy") / side)})
        met = split_join(around_spots, dealt, ["screen_id", "_tx", "_ty"], spread=["_x", "_y"])
        far = (F.pow(F.col("cx") - F.col("_x"), 2) + F.pow(F.col("cy") - F.col("_y"), 2)).alias("d")
        best = met.groupBy("screen_id", "_x", "_y").agg(F.min(F.struct(far, F.col("element_id"))).alias("best")).filter(F.col("best.d") <= side * side)
        best = cut(best.select("screen_id", "_x", "_y", F.col("best.element_id").alias("element_id")))
        done.append(best)
        left = cut(left.join(best, ["screen_id", "_x", "_y"], "left_anti"))
        side *= 2
    out = done[0] if done else spots.limit(0).withColumn("element_id", F.lit(None).cast(centres.schema["element_id"].dataType))
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def resolve_target(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Target element: by id, else the first containing box, else nearest centre."""
    rows = flat(elements).select("screen_id", "element_id", "x", "y", "w", "h", "cx", "cy")
    rows = cut(_of_screens(rows, requests))  # read by id, by box and by centre
    known = rows.select("screen_id", F.col("element_id").alias("target_id"), F.col("element_id").alias("_by_id")).dropDuplicates(["screen_id", "target_id"])
    named = split_join(requests, known, ["screen_id", "target_id"], how="left")
    open_ = requests.filter("target_id IS NULL")
    inside = points_inside(open_, rows, "target_x", "target_y").groupBy("screen_id", "_x", "_y").agg(F.min("element_id").alias("_inside"))
    inside = cut(inside)
    spots = open_.select("screen_id", F.col("target_x").cast("double").alias("_x"), F.col("target_y").cast("double").alias("_y"))
    near = nearest_centres(spots.join(inside, ["screen_id", "_x", "_y"], "left_anti"), rows, "_x", "_y")
    found = inside.unionAll(near)
    chosen = F.when(F.col("target_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_inside"))
    return _with_spots(named, found, "target_x", "target_y").withColumn("resolved_id", chosen).drop("_by_id", "_inside")


def append_region(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Add a user-drawn region per screen as one more element (id = max + 1).

    The region is clamped to the image and at least one pixel wide and high. Its
    colour (hue_deg, sat, val) and contrast_ratio are those measured in the drawn
    box, as columns of ``regions``. The result is described like detected
    elements, so it can be packed, resolved and rated.
    """
    nxt = elements.groupBy("screen_id").agg((F.max("element_id") + 1).alias("_next"))
    x = F.greatest(F.lit(0), F.least(F.col("region_x"), F.col("img_w") - 1)).cast("int")
    y = F.greatest(F.lit(0), F.least(F.col("region_y"), F.col("img_h") - 1)).cast("int")
    measured = ["hue_deg", "sat", "val", "contrast_ratio"]
    placed = regions.join(nxt, "screen_id", "left").select(
        "screen_id",
        F.coalesce("_next", F.lit(0)).cast("bigint").alias("element_id"),
        x.alias("x"),
        y.alias("y"),
        F.greatest(F.lit(1), F.least(F.col("region_w"), F.col("img_w") - x)).cast("int").alias("w"),
        F.greatest(F.lit(1), F.least(F.col("region_h"), F.col("img_h") - y)).cast("int").alias("h"),
        *measured,
        F.lit(True).alias("is_user_region"),
    )
    detected = elements.select(
        "screen_id",
        F.col("element_id").cast("bigint").alias("element_id"),
        "x",
        "y",
        "w",
        "h",
        *measured,
        F.lit(False).alias("is_user_region"),
    )
    return describe_elements(detected.unionByName(placed))


def aoi_hits(fixations: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per fixation and element hit; misses keep a null element."""
    return _with_spots(fixations, points_inside(fixations, elements, "x", "y"), "x", "y")


def aoi_dwell(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("element_id").isNotNull()).groupBy("screen_id", "element_id").agg(
        F.count(F.lit(1)).alias("n_fixations"), F.sum("duration_ms").alias("dwell_ms")
    )


def angular_size(df: DataFrame, preset: str = "preset") -> DataFrame:
    """Visual angle of the element diagonal; unknown preset is a desktop."""
    key = F.lower(F.trim(F.col(preset)))
    pick = [F.lit(v) for v in DISPLAY_PRESETS["desktop"]]
    for name, geometry in DISPLAY_PRESETS.items():
        pick = [F.when(key == name, F.lit(g)).otherwise(p) for g, p in zip(geometry, pick)]
    width, height, distance = pick
    px_per_cm = (F.col("img_w") / width + F.col("img_h") / height) / 2.0
    diag_cm = F.sqrt(F.pow(F.col("w"), 2) + F.pow(F.col("h"), 2)) / px_per_cm
    return df.withColumn("angular_size", F.degrees(2 * F.atan(diag_cm / (2 * distance))))


def contrast_report(elements: DataFrame) -> DataFrame:
    ratio = F.col("contrast_ratio")
    return elements.groupBy("screen_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.count_if(ratio >= CONTRAST_MIN).alias("n_pass"),
        F.count_if(ratio < CONTRAST_MIN).alias("n_fail"),
        F.min(ratio).alias("min_contrast_ratio"),
        F.avg(ratio).alias("mean_contrast_ratio"),
    )


def worst_contrast(elements: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("screen_id").orderBy("contrast_ratio", "element_id")
    return (
        elements.filter(F.col("contrast_ratio") < CONTRAST_MIN)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def word_count(text: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(WORD))


def owned_boxes(boxes: DataFrame, elements: DataFrame) -> DataFrame:
    """The confident text boxes on an element: screen_id, cx, cy, element_id, _words, and box_id if there is one.

    ``boxes`` hold their ``text``, or its ``words`` if they are counted before.
    """
    # Words are counted once per text; blank boxes add nothing to their element.
    words = F.col("words") if "words" in boxes.columns else word_count("text")
    named = [c for c in ("box_id",) if c in boxes.columns]
    usable = boxes.filter(F.col("conf") >= MIN_TEXT_CONFIDENCE).select("screen_id", "cx", "cy", *named, words.alias("_words"))
    # Cut: read as points, as spots and for the shares of its keys.
    return hit_first(cut(usable), elements).filter(F.col("element_id").isNotNull())


def element_texts(boxes: DataFrame, elements: DataFrame) -> DataFrame:
    """Words and reading seconds per element that carries text."""
    return reading_times(owned_boxes(boxes, elements))


def reading_times(owned: DataFrame) -> DataFrame:
    """``element_texts`` from ``owned_boxes``."""
    words = owned.groupBy("screen_id", "element_id").agg(F.sum("_words").alias("n_words"))
    return words.filter(F.col("n_words") > 0).withColumn(
        "reading_time_s", F.round(F.col("n_words") / (WORDS_PER_MINUTE / 60.0), 3)
    )


def with_text(texts: DataFrame, owned: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``text``: the stripped texts of the element's boxes in box order, one space between. For a few elements a screen.

    ``owned`` are ``owned_boxes``; ``sources`` (box_id, text, conf) has what
    stands in them. A text goes to its element only if that is one of ``texts``.
    """
    shown = owned.filter(F.col("_words") > 0).join(texts.select("screen_id", "element_id"), ["screen_id", "element_id"], "left_semi")
    usable = sources.filter((F.col("conf") >= MIN_TEXT_CONFIDENCE) & (word_count("text") > 0)).select("box_id", F.regexp_replace("text", EDGES, "").alias("text"))
    placed = usable.join(shown.select("box_id", "screen_id", "element_id").distinct(), "box_id")
    parts = F.array_sort(F.collect_list(F.struct("box_id", "text")))
    joined = placed.groupBy("screen_id", "element_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return texts.join(joined, ["screen_id", "element_id"], "left")


def readability_report(texts: DataFrame, elements: DataFrame) -> DataFrame:
    """Per screen: words, reading seconds, text elements and text density."""
    per = texts.groupBy("screen_id").agg(
        F.count(F.lit(1)).alias("n_text_elements"),
        F.sum("n_words").alias("total_words"),
        F.round(F.sum("reading_time_s"), 3).alias("total_reading_time_s"),
    )
    size = F.col("_n")
    sizes = flat(elements).groupBy("screen_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return sizes.join(per, "screen_id", "left").select(
        "screen_id",
        size.alias("n_elements"),
        F.coalesce("n_text_elements", F.lit(0)).alias("n_text_elements"),
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        F.coalesce("total_reading_time_s", F.lit(0.0)).alias("total_reading_time_s"),
        (F.coalesce("n_text_elements", F.lit(0)) / F.greatest(size, F.lit(1))).alias("text_density"),
    )


def longest_texts(texts: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("screen_id").orderBy(F.desc("reading_time_s"), "element_id")
    return texts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _strip_area(boxes: Column) -> Column:
    """Union area of the boxes (structs x0, x1, y0, y1) of one screen.

    Between neighbouring x edges the covered height is constant: it is the union
    of the y ranges that span the strip, summed from top to bottom.
    """
    edges = F.array_sort(
        F.array_distinct(
            F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"]))
        )
    )
    strips = F.arrays_zip(
        F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"),
        F.slice(edges, F.lit(2), F.size(edges) - 1).alias("b"),
    )
    zero = F.lit(0).cast("bigint")

    def height(strip: Column) -> Column:
        spans = F.array_sort(
            F.transform(
                F.filter(boxes, lambda b: (b["x0"] <= strip["a"]) & (b["x1"] >= strip["b"])),
                lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1")),
            )
        )
        start = F.struct(zero.alias("sum"), F.lit(-1).cast("bigint").alias("end"))
        return F.aggregate(
            spans,
            start,
            lambda acc, s: F.struct(
                (
                    acc["sum"] + F.greatest(zero, s["y1"] - F.greatest(s["y0"], acc["end"]))
                ).alias("sum"),
                F.greatest(acc["end"], s["y1"]).alias("end"),
            ),
            lambda acc: acc["sum"],
        )

    return F.aggregate(
        strips, zero, lambda total, s: total + height(s) * (s["b"] - s["a"])
    )


def union_area(rects: DataFrame, direct: int = MAX_ELEMENTS, counts: DataFrame | None = None) -> DataFrame:
    """Pixel area of the union of a screen's rectangles (screen_id, covered).

    Screens with up to ``direct`` rectangles are swept in one array expression.
    A screen with more is found by one surplus rectangle (a per-group limit, so
    nothing larger is ever collected) and goes through the tile masks. If
    ``counts`` (screen_id, n: at least its rectangles) shows no such screen,
    one grouping does.
    """
    filled = rects.filter("r1 > r0 AND c1 > c0")
    w = Window.partitionBy("screen_id").orderBy("c0", "r0", "c1", "r1")
    box = F.struct(
        *[F.col(c).cast("bigint").alias(n) for c, n in (("c0", "x0"), ("c1", "x1"), ("r0", "y0"), ("r1", "y1"))]
    )
    if counts is not None and counts.filter(F.col("n") > direct).isEmpty():
        return filled.groupBy("screen_id").agg(_strip_area(F.collect_list(box)).alias("covered"))
    packed = (
        filled.withColumn("_k", F.row_number().over(w))
        .filter(F.col("_k") <= direct + 1)
        .groupBy("screen_id")
        .agg(F.collect_list(box).alias("_b"))
    )
    swept = packed.filter(F.size("_b") <= direct).select(
        "screen_id", _strip_area(F.col("_b")).alias("covered")
    )
    crowded = packed.filter(F.size("_b") > direct).select("screen_id")
    tiled = (
        tile_coverage(
            split_join(filled, crowded, ["screen_id"], how="left_semi"), ["screen_id"], 16, 60
        )
        .groupBy("screen_id")
        .agg(F.sum("covered").alias("covered"))
    )
    return swept.unionByName(tiled)


def whitespace(elements: DataFrame, screens: DataFrame, direct: int = MAX_ELEMENTS) -> DataFrame:
    """1 - union of the element boxes / image area, exact to the pixel."""
    counts = cut(elements.groupBy("screen_id").agg(F.count(F.lit(1)).alias("n")))
    placed = split_join(elements, screens.select("screen_id", "img_w", "img_h"), ["screen_id"], counts=counts, look=True)
    rects = placed.select(
        "screen_id",
        F.greatest(F.lit(0), "y").alias("r0"),
        F.least(F.col("y") + F.col("h"), "img_h").alias("r1"),
        F.greatest(F.lit(0), "x").alias("c0"),
        F.least(F.col("x") + F.col("w"), "img_w").alias("c1"),
    )
    covered = union_area(rects, direct, counts).withColumnRenamed("covered", "_c")
    share = F.coalesce("_c", F.lit(0)) / (F.col("img_w").cast("double") * F.col("img_h"))
    return screens.join(covered, "screen_id", "left").select(
        "screen_id", clip(1.0 - share, 0, 1).alias("whitespace_ratio")
    )


def _rastered(n: int, box=F.col) -> tuple[Column, list[Column]]:
    """Whether a box (its x, y, w, h) lies on its image, and its ranges r0, r1, c0, c1 on an n by n raster of it."""
    x0, y0 = F.greatest(F.lit(0), box("x")), F.greatest(F.lit(0), box("y"))
    x1 = F.least(box("x") + box("w"), F.col("img_w"))
    y1 = F.least(box("y") + box("h"), F.col("img_h"))
    lo = lambda v, size: F.greatest(F.lit(0), F.floor(v / F.col(size) * n).cast("int"))
    hi = lambda v, size: F.least(F.lit(n), F.ceil(v / F.col(size) * n).cast("int"))
    ranges = [lo(y0, "img_h").alias("r0"), hi(y1, "img_h").alias("r1"), lo(x0, "img_w").alias("c0"), hi(x1, "img_w").alias("c1")]
    return (x1 > x0) & (y1 > y0), ranges


def occupancy(
    elements: DataFrame, screens: DataFrame, grid: int = GRID, sub: int = SUPERSAMPLE
) -> DataFrame:
    """Occupied grid cells of each screen: (screen_id, row, col, covered, occupancy).

    Boxes are rasterised on a grid * sub raster (near edge down, far edge up)
    and united. Empty cells are not listed.
    """
    placed = split_join(elements, screens.select("screen_id", "img_w", "img_h"), ["screen_id"])
    shown, ranges = _rastered(grid * sub)
    rects = placed.filter(shown).select("screen_id", *ranges)
    return tile_coverage(rects, ["screen_id"], sub, sub).select(
        "screen_id",
        F.col("tile_row").alias("row"),
        F.col("tile_col").alias("col"),
        "covered",
        (F.col("covered") / (sub * sub)).alias("occupancy"),
    )


def cell_instability(occ: DataFrame, screens: DataFrame, sub: int = SUPERSAMPLE) -> DataFrame:
    """Population std of every ever-occupied cell over the screens of a product.

    Cells that a screen leaves empty count as zero through the screen count, so
    no zero rows are made. Sums are integers, so the variance is exact.
    """
    count = screens.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_screens"))
    sums = (
        occ.join(screens.select("screen_id", "product_id"), "screen_id")
        .groupBy("product_id", "row", "col")
        .agg(F.sum("covered").alias("_s"), F.sum(F.col("covered") * F.col("covered")).alias("_q"))
    )
    n = F.col("n_screens")
    spread = F.sqrt((n * F.col("_q") - F.col("_s") * F.col("_s")).cast("double"))
    return sums.join(count, "product_id").select(
        "product_id", "row", "col", (spread / (n * sub * sub)).alias("cell_std")
    )


def occupancy_consistency(cells: DataFrame, screens: DataFrame) -> DataFrame:
    per = cells.groupBy("product_id").agg(F.avg("cell_std").alias("_m"))
    count = screens.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_screens"))
    return count.join(per, "product_id", "left").select(
        "product_id",
        "n_screens",
        clip(1.0 - 2.0 * F.coalesce("_m", F.lit(0.0)), 0, 1).alias("occupancy_consistency"),
    )


def consecutive_pairs(packed: DataFrame, screens: DataFrame) -> DataFrame:
    """Each screen next to its successor: equality on (product, order + 1)."""
    s = screens.select("screen_id", "product_id", "screen_ord", "img_w", "img_h").join(
        packed, "screen_id", "left"
    )
    a = s.select(
        "product_id",
        "screen_ord",
        F.col("elements").alias("a"),
        F.col("img_w").alias("aw"),
        F.col("img_h").alias("ah"),
    )
    b = s.select(
        "product_id",
        (F.col("screen_ord") - 1).alias("screen_ord"),
        F.col("elements").alias("b"),
        F.col("img_w").alias("bw"),
        F.col("img_h").alias("bh"),
    )
    return a.join(b, ["product_id", "screen_ord"])


def candidate_matches(pairs: DataFrame, max_cost: float = MAX_COST) -> DataFrame:
    """Array of (cost, i, j, distance) within the cut-off, cheapest first."""
    total = W_POSITION + W_SIZE + W_COLOR

    def cost(e: Column, i: Column, o: Column, j: Column) -> Column:
        dx = e["cx"] / F.col("aw") - o["cx"] / F.col("bw")
        dy = e["cy"] / F.col("ah") - o["cy"] / F.col("bh")
        dist = F.sqrt(dx * dx + dy * dy) / math.sqrt(2.0)
        size = F.abs(
            (e["w"] * e["h"]) / (F.col("aw") * F.col("ah"))
            - (o["w"] * o["h"]) / (F.col("bw") * F.col("bh"))
        )
        color = F.when(e["color"] == o["color"], F.lit(0.0)).otherwise(F.lit(1.0))
        value = (W_POSITION * dist + W_SIZE * size + W_COLOR * color) / total
        return F.struct(value.alias("cost"), i.alias("i"), j.alias("j"), dist.alias("distance"))

    table = F.flatten(
        F.transform("a", lambda e, i: F.transform("b", lambda o, j: cost(e, i, o, j)))
    )
    near = F.array_sort(F.filter(table, lambda m: m["cost"] <= max_cost))
    return pairs.withColumn("matches", F.coalesce(near, F.expr("array()")))


def match_greedily(candidates: DataFrame) -> DataFrame:
    """One-to-one matches, lowest cost first (ties by element order)."""
    taken = F.aggregate(
        "matches",
        F.slice(F.col("matches"), 1, 0),
        lambda acc, m: F.when(
            F.exists(acc, lambda t: (t["i"] == m["i"]) | (t["j"] == m["j"])), acc
        ).otherwise(F.concat(acc, F.array(m))),
    )
    # Made by a generator: a filter on the matches would move below a projection and compute them again there.
    return candidates.select("*", F.explode_outer(F.array(taken)).alias("matched"))


def verdict(consistency: Column) -> Column:
    return (
        F.when(consistency >= 0.85, F.lit(VERDICTS[0]))
        .when(consistency >= 0.6, F.lit(VERDICTS[1]))
        .otherwise(F.lit(VERDICTS[2]))
    )


SCREEN_RUN = 1024  # screens of a product that lie in one task


def _beside_next(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each screen with its elements (a) and those of its successor (b, null if there is none) under ``keys``."""
    after = Window.partitionBy(*keys).orderBy("screen_ord")
    # One by one: a struct of them would be made, and shuffled, beside them.
    following = {f"_next_{c}": F.lead(c).over(after) for c in ("screen_ord", "elements", "img_w", "img_h")}
    paired = F.col("product_id").isNotNull() & (F.col("_next_screen_ord") == F.col("screen_ord") + 1)
    return placed.withColumns(following).filter("_own").select(
        *keys,
        "screen_id",
        "screen_ord",
        "img_w",
        "img_h",
        "elements",
        F.when(paired, F.col("elements")).alias("a"),
        F.col("img_w").alias("aw"),
        F.col("img_h").alias("ah"),
        F.when(paired, F.col("_next_elements")).alias("b"),
        F.col("_next_img_w").alias("bw"),
        F.col("_next_img_h").alias("bh"),
    )


_SUMS = ["n_matched", "n_possible", "_moved", "max_displacement"]


def _match_sums() -> list[Column]:
    """Of a pair: matches made and possible, sum and largest of their distances."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return [
        F.size("matched").alias("n_matched"),
        F.least(F.greatest(size("a"), F.lit(0)), F.greatest(size("b"), F.lit(0))).alias("n_possible"),
        F.aggregate("matched", F.lit(0.0), lambda s, m: s + m["distance"]).alias("_moved"),
        F.array_max(F.transform("matched", lambda m: m["distance"])).alias("max_displacement"),
    ]


def _with_cells(screens: DataFrame, grid: int, sub: int) -> DataFrame:
    """Adds _cells (cell, covered) from the packed elements: what ``occupancy`` gives, without a row per box and cell."""

    def cut_at_cells(r: Column) -> Column:
        def piece(i: Column, j: Column) -> Column:
            sides = {"y0": F.greatest(r["r0"], i * sub), "y1": F.least(r["r1"], (i + 1) * sub), "x0": F.greatest(r["c0"], j * sub), "x1": F.least(r["c1"], (j + 1) * sub)}
            return F.struct((i * grid + j).alias("cell"), *[v.cast("bigint").alias(k) for k, v in sides.items()])

        def touched(low: str, high: str) -> Column:
            return F.sequence(F.floor(r[low] / sub).cast("int"), F.floor((r[high] - 1) / sub).cast("int"))

        return F.flatten(F.transform(touched("r0", "r1"), lambda i: F.transform(touched("c0", "c1"), lambda j: piece(i, j))))

    on_image = F.filter("elements", lambda e: _rastered(grid * sub, lambda c: e[c])[0])
    rects = F.transform(on_image, lambda e: F.struct(*_rastered(grid * sub, lambda c: e[c])[1]))
    filled = F.filter(rects, lambda r: (r["r1"] > r["r0"]) & (r["c1"] > r["c0"]))
    pieces = screens.withColumn("_pieces", F.flatten(F.transform(filled, cut_at_cells)))
    one = lambda p: (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])
    groups = F.transform(F.array_distinct("_pieces.cell"), lambda c: F.filter("_pieces", lambda p: p["cell"] == c))
    area = lambda g: F.when(F.size(g) == 1, one(g[0])).otherwise(_strip_area(g))
    return pieces.withColumn("_cells", F.transform(groups, lambda g: F.struct(g[0]["cell"].alias("cell"), area(g).alias("covered")))).drop("_pieces")


def _consistency_parts(elements: DataFrame, screens: DataFrame, run: int, grid: int, sub: int) -> DataFrame:
    """Per product: n_screens, the sums of its matches, and _cells (sum and sum of squares of ``covered`` of each cell ever occupied).

    The elements of a screen are packed where they are numbered and dealt once,
    by product; matches, masks and cells are made there. If a product has more
    than ``run`` screens, products are dealt in runs of so many, the first
    screen of a run also to the run before it, and the sums of runs are added.
    """
    placed = screens.select("screen_id", "product_id", "screen_ord", "img_w", "img_h").join(
        pack(elements, "x", "y", fields=MATCHED), "screen_id", "left"
    )
    keys, placed = ["product_id"], placed.withColumn("_own", F.lit(True))
    crowded = screens.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > run)
    if not crowded.isEmpty():
        own, before = (F.floor((F.col("screen_ord") - back) / run) for back in (0, 1))
        keys.append("_run")
        placed = placed.withColumn("_run", F.explode(F.array_distinct(F.array(own, before)))).withColumn("_own", F.col("_run").eqNullSafe(own))
    matched = match_greedily(candidate_matches(_beside_next(placed, keys)))

    rows = _with_cells(matched.select(*keys, "img_w", "img_h", "elements", *_match_sums()), grid, sub)

    # A screen becomes a row with its sums and no cell, and a row per cell it occupies.
    owned = F.when(F.col("product_id").isNotNull(), F.col("_cells"))
    opened = rows.select(*keys, *_SUMS, F.posexplode(F.concat(F.array(F.lit(None)), F.coalesce(owned, F.array()))).alias("_at", "_cell"))
    first, covered = F.col("_at") == 0, F.col("_cell.covered")
    opened = opened.select(
        *keys, "_cell.cell", F.when(first, 1).alias("n_screens"), *[F.when(first, F.col(c)).alias(c) for c in _SUMS],
        covered.alias("_s"), (covered * covered).alias("_q"),
    )
    added = {c: F.sum(c).alias(c) for c in ("n_screens", *_SUMS, "_s", "_q")} | {"max_displacement": F.max("max_displacement").alias("max_displacement")}
    cells = opened.groupBy(*keys, "cell").agg(*added.values())
    if "_run" in keys:
        cells = cells.groupBy("product_id", "cell").agg(*added.values())
    occupied = F.when(F.col("cell").isNotNull(), F.struct("_s", "_q"))
    return cells.groupBy("product_id").agg(*[added[c] for c in ("n_screens", *_SUMS)], F.collect_list(occupied).alias("_cells"))


def screen_consistency(elements: DataFrame, screens: DataFrame, run: int = SCREEN_RUN, grid: int = GRID, sub: int = SUPERSAMPLE) -> DataFrame:
    """Per product: consistency of element positions over its ordered screens (``screen_ord`` is unique in a product).

    Occupancy and ``cell_std`` are those of ``occupancy`` and ``cell_instability``.
    """
    parts = _consistency_parts(elements, screens, run, grid, sub)
    n = F.col("n_screens")
    std = F.transform("_cells", lambda c: F.sqrt((n * c["_q"] - c["_s"] * c["_s"]).cast("double")) / (n * sub * sub))
    mean = F.when(F.size(std) > 0, F.aggregate(std, F.lit(0.0), lambda t, v: t + v) / F.size(std)).otherwise(F.lit(0.0))
    both = parts.select(
        "product_id",
        "n_screens",
        "max_displacement",
        clip(1.0 - 2.0 * mean, 0, 1).alias("occupancy_consistency"),
        F.when(F.col("n_matched") > 0, F.col("_moved") / F.col("n_matched")).alias("mean_displacement"),
        F.when(F.col("n_possible") > 0, F.col("n_matched") / F.col("n_possible")).otherwise(F.lit(0.0)).alias("match_coverage"),
    )
    cover = F.col("match_coverage")
    moved = clip(1.0 - 2.0 * F.col("mean_displacement"), 0, 1)
    score = F.when(
        F.col("mean_displacement").isNotNull(),
        cover * moved + (1.0 - cover) * F.col("occupancy_consistency"),
    ).otherwise(F.col("occupancy_consistency"))
    return both.select(
        "product_id",
        "n_screens",
        F.round(score, 4).alias("consistency_score"),
        F.round(1.0 - score, 4).alias("layout_instability"),
        F.round("mean_displacement", 4).alias("mean_element_displacement"),
        F.round("max_displacement", 4).alias("max_element_displacement"),
        F.round("occupancy_consistency", 4).alias("occupancy_consistency"),
        F.round(cover, 4).alias("match_coverage"),
        verdict(score).alias("interpretation"),
    )
