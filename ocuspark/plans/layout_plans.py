"""Layout queries: elements, hits, occupancy, matching, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import layout
from ocuspark.operators.lineage import cut, stored
from ocuspark.plans.registry import query

E = ("elements",)
ES = ("elements", "screens")

COLOR = """CASE WHEN sat < 0.15e0 THEN CASE WHEN val < 0.3e0 THEN 'black' WHEN val > 0.8e0 THEN 'white' ELSE 'gray' END
  WHEN hue_deg < 15 OR hue_deg >= 345 THEN 'red' WHEN hue_deg < 45 THEN 'orange' WHEN hue_deg < 75 THEN 'yellow'
  WHEN hue_deg < 165 THEN 'green' WHEN hue_deg < 195 THEN 'cyan' WHEN hue_deg < 270 THEN 'blue' ELSE 'purple' END"""
DESC = f"""
WITH el AS (SELECT *, x + w / 2e0 AS cx, y + h / 2e0 AS cy, CAST(w AS BIGINT) * h AS area, {COLOR} AS color,
  contrast_ratio >= 3 AS contrast_pass FROM elements)
"""


def _elements(t):
    return layout.describe_elements(t["elements"])


@query(
    "layout_color_and_contrast_flags",
    DESC + "SELECT screen_id, element_id, color, contrast_pass, area, cx, cy FROM el",
    E,
)
def _(t):
    return _elements(t).select("screen_id", "element_id", "color", "contrast_pass", "area", "cx", "cy")


@query(
    "layout_candidate_boxes",
    """SELECT e.screen_id, element_id FROM (SELECT *, CAST(w AS BIGINT) * h AS area, w / greatest(h, 1) AS aspect FROM (
      SELECT screen_id, element_id, w * (element_id % 12) AS w, h // (1 + element_id % 4) AS h FROM elements)) e
    JOIN screens s ON e.screen_id = s.screen_id
    WHERE area >= 400 AND area <= 0.5 * img_w * img_h AND aspect BETWEEN 0.05 AND 20""",
    ES,
)
def _(t):
    stretched = t["elements"].selectExpr(
        "screen_id", "element_id", "cast(w * (element_id % 12) as int) as w", "cast(h div (1 + element_id % 4) as int) as h"
    )
    return layout.candidate_boxes(stretched.join(t["screens"], "screen_id")).select("screen_id", "element_id")


# Crowded screens for suppression: many orders share a screen and a grid of cells.
CROWDED = """SELECT l_orderkey % 300 AS screen_id,
  row_number() OVER (PARTITION BY l_orderkey % 300 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS element_id,
  CAST((l_partkey % 20) * 60 AS INT) AS x, CAST((l_suppkey % 10) * 70 AS INT) AS y,
  CAST(60 + l_quantity AS INT) AS w, CAST(70 + l_quantity AS INT) AS h FROM {lineitem} l"""


NMS_SQL = "WITH RECURSIVE crowded AS (" + CROWDED.replace("{lineitem}", "lineitem") + """),
ordered AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY w * h DESC, element_id) AS k FROM crowded),
walk AS (
  SELECT screen_id, k, [struct_pack(id := element_id, x := x, y := y, w := w, h := h)] AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.screen_id, o.k, CASE WHEN len(wk.kept) >= 80 OR len(list_filter(wk.kept, lambda b:
      greatest(0, least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x)) * greatest(0, least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y))
      > 0.5 * (b.w * b.h + o.w * o.h - greatest(0, least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x))
        * greatest(0, least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y))))) > 0 THEN wk.kept
    ELSE list_append(wk.kept, struct_pack(id := o.element_id, x := o.x, y := o.y, w := o.w, h := o.h)) END
  FROM walk wk JOIN ordered o ON o.screen_id = wk.screen_id AND o.k = wk.k + 1),
last AS (SELECT screen_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)
SELECT screen_id, unnest(kept).id AS element_id FROM last"""


@query("layout_overlap_suppression", NMS_SQL)
def _(t):
    crowded = t.spark.sql(CROWDED, lineitem=t["lineitem"])
    return layout.suppress_overlaps(crowded)


@query(
    "layout_largest_elements",
    "WITH crowded AS (" + CROWDED.replace("{lineitem}", "lineitem") + """)
    SELECT screen_id, element_id FROM (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY w * h DESC, element_id) AS k
      FROM crowded) c WHERE k <= 80""",
)
def _(t):
    crowded = t.spark.sql(CROWDED, lineitem=t["lineitem"]).withColumn(
        "area", F.col("w").cast("bigint") * F.col("h")
    )
    return layout.largest_elements(crowded).select("screen_id", "element_id")


PRESETS = " ".join(
    f"WHEN '{k}' THEN {{{i}}}" for i, k in enumerate(layout.DISPLAY_PRESETS)
)


def _preset(i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in layout.DISPLAY_PRESETS.items())
    return f"CASE lower(trim(preset)) {whens} ELSE {layout.DISPLAY_PRESETS['desktop'][i]}e0 END"


PRESET_KEY = """CASE screen_id % 6 WHEN 0 THEN 'phone' WHEN 1 THEN ' Laptop' WHEN 2 THEN 'desktop' WHEN 3 THEN 'hud'
  WHEN 4 THEN 'ivi_12' ELSE 'watch' END"""


@query(
    "layout_angular_size",
    f"""SELECT screen_id, element_id, round(degrees(2 * atan(sqrt(w * w + h * h) / ((1200 / pw + 800 / ph) / 2) / (2 * pd))), 6)
      AS angular_size FROM (SELECT *, {_preset(0)} AS pw, {_preset(1)} AS ph, {_preset(2)} AS pd
      FROM (SELECT *, {PRESET_KEY} AS preset FROM elements) e) p""",
    E,
)
def _(t):
    e = t["elements"].withColumns(
        {"preset": F.expr(PRESET_KEY), "img_w": F.lit(1200), "img_h": F.lit(800)}
    )
    return layout.angular_size(e).select("screen_id", "element_id", r6("angular_size").alias("angular_size"))


@query(
    "layout_contrast_report",
    """SELECT screen_id, count(*) AS n_elements, count(*) FILTER (contrast_ratio >= 3) AS n_pass,
      count(*) FILTER (contrast_ratio < 3) AS n_fail, round(min(contrast_ratio), 6) AS min_contrast_ratio,
      round(avg(contrast_ratio), 6) AS mean_contrast_ratio FROM elements GROUP BY 1""",
    E,
)
def _(t):
    r = layout.contrast_report(t["elements"])
    return r.select(
        "screen_id", "n_elements", "n_pass", "n_fail",
        r6("min_contrast_ratio").alias("min_contrast_ratio"), r6("mean_contrast_ratio").alias("mean_contrast_ratio"),
    )


@query(
    "layout_worst_contrast",
    """SELECT screen_id, element_id, round(contrast_ratio, 2) AS contrast_ratio, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY screen_id ORDER BY contrast_ratio, element_id) AS INT) AS rank
      FROM elements WHERE contrast_ratio < 3) w WHERE rank <= 5""",
    E,
)
def _(t):
    return layout.worst_contrast(t["elements"]).select(
        "screen_id", "element_id", F.round("contrast_ratio", 2).alias("contrast_ratio"), "rank"
    )


OCR_HIT = """
WITH hit AS (SELECT b.box_id, b.screen_id, min(e.element_id) AS element_id FROM ocr_boxes b LEFT JOIN elements e
  ON e.screen_id = b.screen_id AND b.cx BETWEEN e.x AND e.x + e.w AND b.cy BETWEEN e.y AND e.y + e.h GROUP BY 1, 2)
"""
OE = ("ocr_boxes", "elements")


@query("layout_text_box_owner", OCR_HIT + "SELECT box_id, screen_id, element_id FROM hit", OE)
def _(t):
    hit = layout.hit_first(t["ocr_boxes"], t["elements"])
    return hit.select("box_id", "screen_id", "element_id")


# Every box hits: the text sits at the centre of an element of its screen.
BOXES = """SELECT d.doc_id AS box_id, e.screen_id, e.x + e.w / 2e0 AS cx, e.y + e.h / 2e0 AS cy, d.@content@, (d.n_chars % 100) / 1e2 AS conf
  FROM {documents} d JOIN {elements} e ON e.screen_id = d.doc_id AND e.element_id = 1 + d.doc_id % 3"""
TEXTS = BOXES.replace("@content@", "text")
WORDS_SQL = (
    "WITH texts AS (" + TEXTS.replace("{documents}", "documents").replace("{elements}", "elements") + "),\n"
    + f"""counted AS (SELECT box_id, screen_id, cx, cy, len(regexp_extract_all(text, '{layout.WORD}')) AS words
  FROM texts WHERE conf >= 0.3e0),
owned AS (SELECT c.box_id, c.screen_id, c.words, min(e.element_id) AS element_id FROM counted c JOIN elements e
  ON e.screen_id = c.screen_id AND c.cx BETWEEN e.x AND e.x + e.w AND c.cy BETWEEN e.y AND e.y + e.h
  WHERE c.words > 0 GROUP BY 1, 2, 3),
element_texts AS (SELECT screen_id, element_id, CAST(sum(words) AS BIGINT) AS n_words,
    round(sum(words) / (238 / 60e0), 3) AS reading_time_s FROM owned GROUP BY 1, 2)
"""
)


def _owned(t):
    # Only screens that a document names have texts; the others are neither numbered nor read again.
    # Stored: a few are broadcast to the elements.
    screens = stored(t["documents"].select(F.col("doc_id").alias("screen_id")).distinct(), "named-screens")
    named = cut(t.elements_of(screens))
    # Words are counted before the join, so that it shuffles no text.
    counted = t["documents"].select("doc_id", "n_chars", layout.word_count("text").alias("words"))
    return layout.owned_boxes(t.spark.sql(BOXES.replace("@content@", "words"), documents=counted, elements=named), named)


def _texts(t):
    return layout.reading_times(_owned(t))


@query(
    "layout_element_texts",
    WORDS_SQL + "SELECT screen_id, element_id, n_words, reading_time_s FROM element_texts",
    E,
)
def _(t):
    return _texts(t)


@query(
    "layout_readability_report",
    WORDS_SQL + """, sizes AS (SELECT screen_id, CAST(count(*) AS INT) AS n_elements FROM elements GROUP BY 1)
    SELECT s.screen_id, n_elements, coalesce(k, 0) AS n_text_elements, coalesce(w, 0) AS total_words,
      coalesce(r, 0) AS total_reading_time_s, round(coalesce(k, 0) / n_elements, 6) AS text_density
    FROM sizes s LEFT JOIN (SELECT screen_id, count(*) AS k, CAST(sum(n_words) AS BIGINT) AS w, round(sum(reading_time_s), 3) AS r
      FROM element_texts GROUP BY 1) x ON s.screen_id = x.screen_id""",
    E,
)
def _(t):
    r = layout.readability_report(_texts(t), t["elements"])
    return r.withColumn("text_density", r6("text_density"))


@query(
    "layout_longest_texts",
    WORDS_SQL + """SELECT screen_id, element_id, n_words, reading_time_s, rank FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY screen_id ORDER BY reading_time_s DESC, element_id) AS INT) AS rank FROM element_texts) q WHERE rank <= 5""",
    E,
)
def _(t):
    return layout.longest_texts(_texts(t))


@query(
    "layout_longest_texts_with_text",
    WORDS_SQL + f""", top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY screen_id ORDER BY reading_time_s DESC, element_id) AS INT) AS rank FROM element_texts) q WHERE rank <= 5),
    parts AS (SELECT b.box_id, b.screen_id, regexp_replace(b.text, '{layout.EDGES}', '', 'g') AS text, min(e.element_id) AS element_id
      FROM texts b JOIN elements e ON e.screen_id = b.screen_id AND b.cx BETWEEN e.x AND e.x + e.w AND b.cy BETWEEN e.y AND e.y + e.h
      WHERE b.conf >= 0.3e0 AND len(regexp_extract_all(b.text, '{layout.WORD}')) > 0 GROUP BY ALL)
    SELECT t.screen_id, t.element_id, n_words, reading_time_s, rank, string_agg(p.text, ' ' ORDER BY p.box_id) AS text
    FROM top t JOIN parts p USING (screen_id, element_id) GROUP BY ALL""",
    E,
)
def _(t):
    owned = cut(_owned(t))
    sources = t["documents"].selectExpr("doc_id as box_id", "text", "(n_chars % 100) / 1e2 as conf")
    return layout.with_text(layout.longest_texts(layout.reading_times(owned)), owned, sources)


@query(
    "layout_target_resolution",
    DESC + """, sel AS (SELECT r.*, e.element_id, e.element_id = r.target_id AS is_id,
      r.target_x BETWEEN e.x AND e.x + e.w AND r.target_y BETWEEN e.y AND e.y + e.h AS inside,
      pow(e.cx - r.target_x, 2) + pow(e.cy - r.target_y, 2) AS d
      FROM target_requests r LEFT JOIN el e ON e.screen_id = r.screen_id)
    SELECT request_id, CASE WHEN max(target_id) IS NOT NULL THEN min(element_id) FILTER (is_id)
      WHEN max(target_x) IS NULL OR max(target_y) IS NULL THEN NULL
      ELSE coalesce(min(element_id) FILTER (inside), arg_min(element_id, struct_pack(d := d, e := element_id))) END AS resolved_id
    FROM sel GROUP BY request_id""",
    ("target_requests", "elements"),
)
def _(t):
    out = layout.resolve_target(t["target_requests"], _elements(t))
    return out.select("request_id", "resolved_id")


@query(
    "layout_aoi_hits",
    """SELECT f.fixation_id, f.screen_id, e.element_id FROM screen_fixations f LEFT JOIN elements e ON e.screen_id = f.screen_id
      AND f.x BETWEEN e.x AND e.x + e.w AND f.y BETWEEN e.y AND e.y + e.h""",
    ("screen_fixations", "elements"),
)
def _(t):
    hits = layout.aoi_hits(t["screen_fixations"], t["elements"])
    return hits.select("fixation_id", "screen_id", "element_id")


@query(
    "layout_aoi_dwell",
    """SELECT f.screen_id, e.element_id, count(*) AS n_fixations, round(sum(f.duration_ms), 6) AS dwell_ms
      FROM screen_fixations f JOIN elements e ON e.screen_id = f.screen_id
      AND f.x BETWEEN e.x AND e.x + e.w AND f.y BETWEEN e.y AND e.y + e.h GROUP BY 1, 2""",
    ("screen_fixations", "elements"),
)
def _(t):
    dwell = layout.aoi_dwell(layout.aoi_hits(t["screen_fixations"], t["elements"]))
    return dwell.withColumn("dwell_ms", r6("dwell_ms"))


@query(
    "layout_user_region",
    f"""WITH c AS (SELECT *, greatest(0, least(region_x, img_w - 1)) AS x, greatest(0, least(region_y, img_h - 1)) AS y FROM regions),
    u AS (SELECT screen_id, element_id, x, y, w, h, hue_deg, sat, val, contrast_ratio, false AS is_user_region FROM elements
    UNION ALL SELECT c.screen_id, coalesce(m.top + 1, 0), x, y, greatest(1, least(region_w, img_w - x)),
      greatest(1, least(region_h, img_h - y)), hue_deg, sat, val, contrast_ratio, true
    FROM c LEFT JOIN (SELECT screen_id, max(element_id) AS top FROM elements GROUP BY 1) m ON c.screen_id = m.screen_id)
    SELECT screen_id, element_id, x, y, w, h, is_user_region, x + w / 2e0 AS cx, y + h / 2e0 AS cy, CAST(w AS BIGINT) * h AS area,
      {COLOR} AS color, contrast_ratio >= 3 AS contrast_pass FROM u""",
    ("regions", "elements"),
)
def _(t):
    return layout.append_region(t["elements"], t["regions"]).drop("hue_deg", "sat", "val", "contrast_ratio")


# Pixel union by coordinate compression: strips between neighbouring x edges,
# and in each strip the union of the y ranges that span it.
UNION_SQL = """
WITH clipped AS (SELECT e.screen_id, least(x, 1200) AS x0, least(x + w, 1200) AS x1, least(y, 800) AS y0, least(y + h, 800) AS y1
  FROM elements e JOIN screens s ON e.screen_id = s.screen_id),
edges AS (SELECT screen_id, x0 AS x FROM clipped UNION SELECT screen_id, x1 FROM clipped),
strips AS (SELECT screen_id, x AS a, lead(x) OVER (PARTITION BY screen_id ORDER BY x) AS b FROM edges),
spans AS (SELECT s.screen_id, s.a, s.b, c.y0, c.y1, max(c.y1) OVER (PARTITION BY s.screen_id, s.a ORDER BY c.y0, c.y1
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM strips s JOIN clipped c ON c.screen_id = s.screen_id AND c.x0 <= s.a AND c.x1 >= s.b WHERE s.b > s.a),
area AS (SELECT screen_id, sum((b - a) * greatest(0, y1 - greatest(y0, coalesce(seen, y0)))) AS covered FROM spans GROUP BY 1)
SELECT s.screen_id, round(1 - coalesce(a.covered, 0) / 960000e0, 9) AS whitespace_ratio
FROM screens s LEFT JOIN area a ON s.screen_id = a.screen_id"""


@query("layout_whitespace", UNION_SQL, ES)
def _(t):
    out = layout.whitespace(t["elements"], t["screens"])
    # Pixel shares of 960 000 can end on half of the sixth decimal, hence nine.
    return out.select("screen_id", F.round("whitespace_ratio", 9).alias("whitespace_ratio"))


# Occupancy of the sub-grid cell by cell, run-length style: per screen and
# sub-row the union of column ranges is split at the ten-cell borders.
OCC_SQL = """
WITH boxes AS (SELECT e.screen_id, s.product_id,
    CAST(floor(x / 1200e0 * 200) AS INT) AS c0, least(200, CAST(ceil(least(x + w, 1200) / 1200e0 * 200) AS INT)) AS c1,
    CAST(floor(y / 800e0 * 200) AS INT) AS r0, least(200, CAST(ceil(least(y + h, 800) / 800e0 * 200) AS INT)) AS r1
  FROM elements e JOIN screens s ON e.screen_id = s.screen_id WHERE x < 1200 AND y < 800),
rowspans AS (SELECT screen_id, product_id, unnest(range(r0, r1)) AS r, c0, c1 FROM boxes),
parts AS (SELECT *, unnest(range(c0 // 20, (c1 - 1) // 20 + 1)) AS col FROM rowspans),
cut AS (SELECT screen_id, product_id, r, col, greatest(c0, col * 20) AS a, least(c1, col * 20 + 20) AS b FROM parts),
seen AS (SELECT *, max(b) OVER (PARTITION BY screen_id, r, col ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cut),
occ AS (SELECT screen_id, product_id, CAST(r // 20 AS INT) AS row, CAST(col AS INT) AS col,
    CAST(sum(greatest(0, b - greatest(a, coalesce(m, a)))) AS BIGINT) AS covered FROM seen GROUP BY 1, 2, 3, 4)
"""


@query(
    "layout_occupancy_grid",
    OCC_SQL + "SELECT screen_id, row, col, covered, round(covered / 400e0, 6) AS occupancy FROM occ",
    ES,
)
def _(t):
    o = layout.occupancy(t["elements"], t["screens"])
    return o.select(
        "screen_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        "covered", r6("occupancy").alias("occupancy"),
    )


CELLS_SQL = OCC_SQL + """, n AS (SELECT product_id, count(*) AS n_screens FROM screens GROUP BY 1),
cells AS (SELECT o.product_id, row, col, sqrt(n_screens * sum(covered * covered) - sum(covered) * sum(covered)) / (n_screens * 400e0) AS cell_std
  FROM occ o JOIN n ON o.product_id = n.product_id GROUP BY o.product_id, row, col, n_screens)
"""


@query(
    "layout_cell_instability",
    CELLS_SQL + "SELECT product_id, row, col, round(cell_std, 6) AS cell_std FROM cells",
    ES,
)
def _(t):
    o = layout.occupancy(t["elements"], t["screens"])
    c = layout.cell_instability(o, t["screens"])
    return c.select(
        "product_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), r6("cell_std").alias("cell_std")
    )


PAIRS_SQL = DESC + """, placed AS (SELECT el.*, s.product_id, s.screen_ord FROM el JOIN screens s ON el.screen_id = s.screen_id),
pairs AS (SELECT a.product_id, a.screen_ord, a.element_id AS ea, b.element_id AS eb,
    sqrt(pow(a.cx / 1200 - b.cx / 1200, 2) + pow(a.cy / 800 - b.cy / 800, 2)) / sqrt(2e0) AS distance,
    abs(a.area / 960000 - b.area / 960000) AS size, CASE WHEN a.color = b.color THEN 0e0 ELSE 1e0 END AS diff
  FROM placed a JOIN placed b ON a.product_id = b.product_id AND b.screen_ord = a.screen_ord + 1),
costs AS (SELECT *, (distance + 0.3e0 * size + 0.3e0 * diff) / 1.6e0 AS cost FROM pairs)
"""


@query(
    "layout_pair_costs",
    PAIRS_SQL + "SELECT product_id, screen_ord, round(cost, 9) AS cost, round(distance, 9) AS distance FROM costs WHERE cost <= 0.35e0",
    ES,
)
def _(t):
    m = layout.candidate_matches(layout.consecutive_pairs(layout.pack(_elements(t), fields=layout.MATCHED), t["screens"]))
    return m.select("product_id", "screen_ord", F.inline("matches")).select(
        "product_id", "screen_ord", F.round("cost", 9).alias("cost"), F.round("distance", 9).alias("distance")
    )


# Greedy matching as repeated picks: a pair is taken when it is the cheapest open
# pair of both its elements; with ordered ties this is the greedy result.
MATCH_SQL = PAIRS_SQL.replace("WITH el AS", "WITH RECURSIVE el AS") + """,
ranked AS (SELECT product_id, screen_ord, ea, eb, distance,
    row_number() OVER (PARTITION BY product_id, screen_ord ORDER BY cost, ea, eb) AS k FROM costs WHERE cost <= 0.35e0),
greedy AS (
  SELECT product_id, screen_ord, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ta, CAST([] AS BIGINT[]) AS tb, CAST([] AS DOUBLE[]) AS ds
  FROM (SELECT DISTINCT product_id, screen_ord FROM ranked) r
  UNION ALL
  SELECT g.product_id, g.screen_ord, r.k,
    CASE WHEN list_contains(g.ta, r.ea) OR list_contains(g.tb, r.eb) THEN g.ta ELSE list_append(g.ta, r.ea) END,
    CASE WHEN list_contains(g.ta, r.ea) OR list_contains(g.tb, r.eb) THEN g.tb ELSE list_append(g.tb, r.eb) END,
    CASE WHEN list_contains(g.ta, r.ea) OR list_contains(g.tb, r.eb) THEN g.ds ELSE list_append(g.ds, r.distance) END
  FROM greedy g JOIN ranked r ON r.product_id = g.product_id AND r.screen_ord = g.screen_ord AND r.k = g.k + 1),
done AS (SELECT product_id, screen_ord, arg_max(ds, k) AS ds FROM greedy GROUP BY 1, 2)
"""


@query(
    "layout_greedy_matches",
    MATCH_SQL + """SELECT product_id, screen_ord, CAST(len(ds) AS INT) AS n_matched, round(list_sum(ds), 6) AS displacement
      FROM done WHERE len(ds) > 0""",
    ES,
)
def _(t):
    pairs = layout.consecutive_pairs(layout.pack(_elements(t), fields=layout.MATCHED), t["screens"])
    m = layout.match_greedily(layout.candidate_matches(pairs)).filter(F.size("matched") > 0)
    total = F.aggregate("matched", F.lit(0.0), lambda s, e: s + e["distance"])
    return m.select("product_id", "screen_ord", F.size("matched").alias("n_matched"), r6(total).alias("displacement"))


CONSISTENCY_SQL = MATCH_SQL + OCC_SQL.replace("WITH boxes", ", boxes") + """, n AS (SELECT product_id, count(*) AS n_screens FROM screens GROUP BY 1),
cells AS (SELECT o.product_id, row, col, sqrt(n_screens * sum(covered * covered) - sum(covered) * sum(covered)) / (n_screens * 400e0) AS cell_std
  FROM occ o JOIN n ON o.product_id = n.product_id GROUP BY o.product_id, row, col, n_screens),
oc AS (SELECT n.product_id, n.n_screens, least(greatest(1 - 2 * coalesce(avg(cell_std), 0), 0), 1) AS occupancy_consistency
  FROM n LEFT JOIN cells c ON n.product_id = c.product_id GROUP BY 1, 2),
sizes AS (SELECT s.product_id, s.screen_ord, count(e.element_id) AS k FROM screens s LEFT JOIN elements e ON e.screen_id = s.screen_id GROUP BY 1, 2),
possible AS (SELECT a.product_id, sum(least(a.k, b.k)) AS n_possible FROM sizes a JOIN sizes b
  ON a.product_id = b.product_id AND b.screen_ord = a.screen_ord + 1 GROUP BY 1),
moved AS (SELECT product_id, sum(len(ds)) AS n_matched, sum(list_sum(ds)) AS s, max(list_max(ds)) AS w FROM done GROUP BY 1),
blend AS (SELECT oc.*, m.s / m.n_matched AS md, m.w, coalesce(CASE WHEN p.n_possible > 0 THEN coalesce(m.n_matched, 0) / p.n_possible END, 0) AS cover
  FROM oc LEFT JOIN possible p ON oc.product_id = p.product_id LEFT JOIN moved m ON oc.product_id = m.product_id),
final AS (SELECT *, CASE WHEN md IS NOT NULL THEN cover * least(greatest(1 - 2 * md, 0), 1) + (1 - cover) * occupancy_consistency
  ELSE occupancy_consistency END AS score FROM blend)
SELECT product_id, n_screens, round(score, 4) AS consistency_score, round(1 - score, 4) AS layout_instability,
  round(md, 4) AS mean_element_displacement, round(w, 4) AS max_element_displacement,
  round(occupancy_consistency, 4) AS occupancy_consistency, round(cover, 4) AS match_coverage,
  CASE WHEN score >= 0.85 THEN 'highly consistent layout across screens' WHEN score >= 0.6 THEN 'moderately consistent layout'
    ELSE 'low layout consistency - recurring controls likely move between screens' END AS interpretation FROM final"""


@query("layout_screen_consistency", CONSISTENCY_SQL, ES)
def _(t):
    return layout.screen_consistency(layout.describe_elements(t.elements_by_screen()), t["screens"])
