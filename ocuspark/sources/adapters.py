"""Domain tables derived from the star-schema test tables.

Each text is plain SQL that both Spark and the checking engine run; the few
spellings that differ are marked ``@name@`` and filled in per engine. Spark
receives the base tables as DataFrames, so no views are registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAZE = """
SELECT user_id AS recording_id, event_id AS sample_id,
  CAST(floor((@us@ - 1704067200000000) / @squeeze@) AS BIGINT) AS device_us,
  CASE WHEN event_type = 'error' OR event_id % 41 = 0 THEN NULL
       WHEN event_type = 'purchase' AND value > 100 THEN 1.2e0
       ELSE 5e-1 + ((value % 30) - 15) / 883e0 + jump END AS left_x,
  CASE WHEN event_type = 'error' THEN NULL ELSE 5e-1 + ((k % 30) - 15) / 682e0 END AS left_y,
  CASE WHEN event_type = 'signup' THEN NULL
       WHEN event_type = 'purchase' AND value > 100 THEN 1.2e0
       ELSE 5e-1 + ((value % 30) - 14) / 883e0 + jump END AS right_x,
  CASE WHEN event_type = 'signup' THEN NULL ELSE 5e-1 + ((k % 30) - 14) / 682e0 END AS right_y,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS left_valid,
  CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END AS right_valid
FROM (SELECT *, CAST(substr(props, 7, length(props) - 7) AS INT) AS k,
        CASE WHEN event_id % 53 = 0 THEN 2e-1 ELSE 0e0 END AS jump FROM {events}) e
"""

TABLES = {
    # 400 000-fold time compression shows gaps, 4 000 000-fold shows saccades.
    "gaze_samples": GAZE.replace("@squeeze@", "400000"),
    "fast_gaze_samples": GAZE.replace("@squeeze@", "4000000"),
    "aoi_trials": """
SELECT l_suppkey % 27 AS participant,
  concat('img_', CAST(l_partkey % 150 AS VARCHAR(9))) AS image_name,
  CASE l_returnflag WHEN 'A' THEN 'Absent' WHEN 'N' THEN 'Low' ELSE 'High' END AS cognitive_load,
  CASE o_orderstatus WHEN 'F' THEN 'Absent' WHEN 'O' THEN 'Static' ELSE 'Dynamic' END AS highlight,
  CASE WHEN l_linenumber = 7 THEN -99.99e0 ELSE l_quantity END AS total_num_fixations,
  l_extendedprice / 100 AS mean_fixation_duration, l_discount * 50 AS fixation_frequency,
  l_quantity * l_extendedprice / 100 AS total_fixation_duration,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS aoi_hit
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""",
    "screens": """
SELECT o_orderkey AS screen_id, o_custkey AS product_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS screen_ord,
  1200 AS img_w, 800 AS img_h FROM {orders} o
""",
    "elements": """
SELECT l_orderkey AS screen_id,
  row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS element_id,
  CAST((l_partkey * 37) % 1000 AS INT) AS x, CAST((l_suppkey * 53) % 650 AS INT) AS y,
  CAST(20 + l_quantity * 3 AS INT) AS w, CAST(20 + l_quantity * 2 AS INT) AS h,
  CAST((l_partkey * 17) % 360 AS DOUBLE) AS hue_deg, l_discount * 10 AS sat,
  1e0 - l_tax * 10 AS val, 1 + l_tax * 60 AS contrast_ratio
FROM {lineitem} l
""",
    "search_trials": """
SELECT l_orderkey % 200 AS screen_id, l_linenumber AS target_id,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 10 ELSE 100 END AS n_exposures,
  row_number() OVER (PARTITION BY l_orderkey % 200, l_linenumber, l_returnflag
     ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS trial,
  l_extendedprice / 50000 AS total_time_s, CAST(l_quantity AS INT) AS n_fixations
FROM {lineitem} l
""",
    "scan_steps": """
SELECT user_id AS scan_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_ord,
  value / 100 AS step_time_s, event_type = 'click' AS is_target FROM {events} e
""",
    "ocr_boxes": """
SELECT d.doc_id AS box_id, s.screen_id, (d.doc_id * 97) % 1200 AS cx, (d.doc_id * 61) % 800 AS cy,
  d.text AS text, (d.n_chars % 100) / 1e2 AS conf
FROM {documents} d
JOIN (SELECT DISTINCT o_orderkey AS screen_id FROM {orders} o) s ON s.screen_id = d.doc_id
""",
    "screen_fixations": """
SELECT event_id AS fixation_id, user_id AS recording_id, event_id % 500 AS screen_id,
  (event_id * 97) % 1200 AS x, (event_id * 61) % 800 AS y, value AS duration_ms FROM {events} e
""",
    "target_requests": """
SELECT event_id AS request_id, event_id % 400 AS screen_id,
  CASE WHEN event_id % 5 = 0 THEN event_id % 9 END AS target_id,
  CASE WHEN event_id % 7 <> 0 THEN (event_id * 97) % 1200 END AS target_x, (event_id * 61) % 800 AS target_y
FROM {events} e
""",
    "regions": """
SELECT o_orderkey AS screen_id, 1200 AS img_w, 800 AS img_h, CAST(o_orderkey % 1400 - 100 AS INT) AS region_x,
  CAST(o_orderkey % 900 - 50 AS INT) AS region_y, CAST(o_orderkey % 333 AS INT) AS region_w,
  CAST(o_orderkey % 127 AS INT) AS region_h, CAST(o_orderkey * 31 % 360 AS DOUBLE) AS hue_deg, o_orderkey % 11 / 10e0 AS sat,
  o_orderkey % 7 / 6e0 AS val, 1e0 + o_orderkey % 9 AS contrast_ratio
FROM {orders} o WHERE o_orderkey % 10 = 0
""",
    "map_pixels": """
SELECT a.vec_id AS map_id, CAST(floor(a.pos / 8e0) AS INT) AS y, CAST(a.pos % 8 AS INT) AS x,
  greatest(CAST(a.v AS DOUBLE), 0e0) AS pred, greatest(CAST(b.v AS DOUBLE), 0e0) AS gt
FROM @emb@ a JOIN @emb@ b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos
""",
    "rgb_pixels": """
SELECT vec_id AS image_id, CAST(floor(pos / 8e0) AS INT) AS y, CAST(pos % 8 AS INT) AS x,
  CAST(floor(abs(CAST(v AS DOUBLE)) * 1e5) AS BIGINT) % 256 AS b,
  CAST(floor(abs(CAST(v AS DOUBLE)) * 4e2) AS BIGINT) % 256 AS g,
  CAST(floor(abs(CAST(v AS DOUBLE)) * 7e3) AS BIGINT) % 256 AS r
FROM @emb@ a
""",
    "image_ids": """
SELECT DISTINCT concat(source, '_', CAST(doc_id % 50 AS VARCHAR(9)), '_',
  CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'highlight' END) AS image_id
FROM {documents} d
""",
    "screen_features": """
SELECT vec_id AS screen_id,
  CASE label % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN 'desktop' ELSE 'poster' END AS category,
  4.28e0 + 1.82e0 * z1 AS shannon_entropy, greatest(35e-3 + 19e-3 * z2, 0e0) AS edge_density,
  greatest(4.16e0 + 1.51e0 * z3, 1e-1) AS feature_congestion, 2.8e0 + 74e-2 * z4 AS subband_entropy,
  least(greatest(34e-2 + 21e-2 * z5, 0e0), 1e0) AS layout_symmetry,
  least(greatest(41e-2 + 14e-2 * z6, 0e0), 1e0) AS chromatic_coherence,
  least(greatest(45e-2 + 17e-2 * z7, 0e0), 1e0) AS visual_hierarchy,
  greatest(26e-2 + 25e-2 * z8, 0e0) AS interactive_element_density,
  least(greatest(43e-2 + 7e-2 * z9, 0e0), 1e0) AS saliency_dispersion,
  greatest(round(5.3e0 + 2.4e0 * z10), 1e0) AS saliency_peak_count,
  least(greatest(38e-2 + 17e-2 * z11, 0e0), 1e0) AS saliency_center_bias,
  least(greatest(57e-2 + 13e-2 * z12, 0e0), 1e0) AS saliency_entropy,
  least(greatest(5e-2 + 3e-2 * z13, 0e0), 1e0) AS saliency_coverage,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE least(greatest(5e-1 + 2e-1 * z14, 0e0), 1e0) END AS whitespace_ratio,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE least(greatest(5e-1 + 2e-1 * z15, 0e0), 1e0) END AS text_density
FROM (SELECT vec_id, label, @z@ FROM {embeddings} m) t
""",
    "screen_tasks": """
SELECT vec_id AS screen_id,
  CASE vec_id % 6 WHEN 0 THEN 'navigation' WHEN 1 THEN 'search' WHEN 2 THEN 'monitoring'
    WHEN 3 THEN 'data_entry' WHEN 4 THEN 'decision' ELSE 'browsing' END AS task_type,
  CASE vec_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'other' END AS target_specificity,
  CASE vec_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'other' END AS time_pressure,
  CASE vec_id % 7 WHEN 0 THEN 'known_item' WHEN 1 THEN 'comparative' WHEN 2 THEN 'exploratory' ELSE 'other' END AS search_mode,
  CASE vec_id % 8 WHEN 0 THEN 'neutral' WHEN 1 THEN 'focused' WHEN 2 THEN 'exploratory' WHEN 3 THEN 'social'
    WHEN 4 THEN 'stress_sensitive' ELSE 'unknown' END AS profile,
  CASE WHEN vec_id % 9 = 0 THEN NULL ELSE (vec_id % 23) / 2e0 END AS estimated_fixation_count,
  CASE WHEN vec_id % 10 = 0 THEN NULL ELSE (vec_id % 13) / 2e0 END AS mean_search_time_s
FROM {embeddings} m
""",
    "class_probabilities": """
SELECT vec_id AS screen_id, e1 / s AS poster, e2 / s AS infographic, e3 / s AS mobile_ui,
  e4 / s AS desktop_ui, e5 / s AS web_page, e6 / s AS natural_image
FROM (SELECT *, e1 + e2 + e3 + e4 + e5 + e6 AS s FROM
  (SELECT vec_id, exp(z1) AS e1, exp(z2) AS e2, exp(z3) AS e3, exp(z4) AS e4, exp(z5) AS e5, exp(z6) AS e6
   FROM (SELECT vec_id, @z@ FROM {embeddings} m) t) u) w
""",
}

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _z(index_from: int) -> str:
    return ", ".join(
        f"8 * CAST(embedding[{i + index_from}] AS DOUBLE) AS z{i + 1}" for i in range(15)
    )


SPARK_WORDS = {
    "@us@": "unix_micros(CAST(ts AS TIMESTAMP))",
    "@emb@": "(SELECT vec_id, pos, v FROM (SELECT vec_id, posexplode(embedding) AS (pos, v)"
    " FROM {embeddings}))",
    "@z@": _z(0),
}
CHECK_WORDS = {
    "@us@": "epoch_us(ts)",
    "@emb@": "(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos"
    " FROM embeddings)",
    "@z@": _z(1),
}


def _fill(text: str, words: dict[str, str]) -> str:
    for mark, spelling in words.items():
        text = text.replace(mark, spelling)
    return text


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(
    spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None, only: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A domain table (or a base table) as a lazy DataFrame.

    ``only`` holds wanted values (one column, named as in the base table) of
    base tables; other rows do not reach the SQL. A filter on its result stays
    above its numbering, so that all rows are shuffled before.

    ``dealt`` names columns by which base tables are shuffled before the SQL
    reads them. Where the SQL numbers rows by such a column, that is the only
    shuffle: under the column's new name, groups and joins need no other, while
    of a shuffle made for the numbering Spark does not know the new name.
    """
    if name in BASE:
        return base_table(spark, sf_dir, name)
    text = _fill(TABLES[name], SPARK_WORDS)
    used = {b: base_table(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text}
    for b, wanted in (only or {}).items():
        used[b] = used[b].join(wanted, wanted.columns, "left_semi")
    for b, column in (dealt or {}).items():
        used[b] = used[b].repartition(column)
    return spark.sql(text, **used)


def check_sql(name: str) -> str:
    """The same table as a subquery for the checking engine."""
    text = _fill(TABLES[name], CHECK_WORDS)
    for b in BASE:
        text = text.replace("{" + b + "}", b)
    return text.strip()
