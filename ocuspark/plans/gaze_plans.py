"""Gaze queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import gaze, ordered
from ocuspark.operators.lineage import cut
from ocuspark.plans.registry import query

POINTS = """
WITH merged AS (SELECT *,
    CASE WHEN left_x IS NOT NULL AND left_y IS NOT NULL AND right_x IS NOT NULL AND right_y IS NOT NULL
         THEN (left_x + right_x) / 2 WHEN left_x IS NULL AND left_y IS NULL THEN right_x
         WHEN right_x IS NULL AND right_y IS NULL THEN left_x END AS gaze_x,
    CASE WHEN left_x IS NOT NULL AND left_y IS NOT NULL AND right_x IS NOT NULL AND right_y IS NOT NULL
         THEN (left_y + right_y) / 2 WHEN left_x IS NULL AND left_y IS NULL THEN right_y
         WHEN right_x IS NULL AND right_y IS NULL THEN left_y END AS gaze_y
  FROM @samples@),
shown AS (SELECT * FROM merged WHERE gaze_x BETWEEN 0 AND 1 AND gaze_y BETWEEN 0 AND 1),
points AS (SELECT recording_id, sample_id, device_us,
    round_even(gaze_x * 883, 0) AS px, round_even(gaze_y * 682, 0) AS py,
    row_number() OVER w AS rn,
    device_us / 1000 - first_value(device_us) OVER w / 1000 AS t_ms
  FROM shown WINDOW w AS (PARTITION BY recording_id ORDER BY device_us, sample_id))
"""


def _repair_sql(c: str, thr: int) -> str:
    taps = [f"lag({c}, {k}) OVER w" for k in (3, 2, 1)]
    taps += [f"lead({c}, {k}) OVER w" for k in (1, 2, 3)]
    near, spread = ", ".join(taps), " + ".join(f"abs({c} - {t})" for t in taps)
    return (
        f"CASE WHEN lag({c}, 3) OVER w IS NOT NULL AND lead({c}, 3) OVER w IS NOT NULL"
        f" AND ({spread}) / 7 > {thr}"
        f" THEN (list_sort([{near}])[3] + list_sort([{near}])[4]) / 2 ELSE {c} END"
    )


W = "WINDOW w AS (PARTITION BY recording_id ORDER BY rn)"
REPAIRED = POINTS + f""",
repaired AS (SELECT recording_id, sample_id, device_us, rn, t_ms,
    {_repair_sql('px', 50)} AS px, {_repair_sql('py', 60)} AS py FROM points {W})
"""
MOTION = REPAIRED + f""",
motion AS (SELECT *,
    coalesce((device_us - lag(device_us) OVER w) / 1000, 0) AS isd_ms,
    coalesce(sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) /
      (CASE WHEN (t_ms - lag(t_ms) OVER w) / 1000 = 0 THEN 0.004e0
            ELSE (t_ms - lag(t_ms) OVER w) / 1000 END * 250), 0) AS velocity
  FROM repaired {W}),
gaps AS (SELECT *, CASE WHEN isd_ms > 99 AND isd_ms < 200 THEN 'Blink_End'
    WHEN isd_ms > 200 THEN 'Noise_End' END AS gap FROM motion)
"""
EVENTS = MOTION + f""",
look AS (SELECT *, velocity > 40 AS fast, gap IS NOT NULL AS is_gap,
    coalesce(lead(velocity, 1) OVER w <= 40, false) AS q1,
    coalesce(lead(velocity, 2) OVER w <= 40, false) AS q2,
    lead(rn, 1) OVER w IS NULL AS final FROM gaps {W}),
acts AS (SELECT *, NOT is_gap AND fast AND NOT q2 AS opens, is_gap OR NOT q1 AS holds FROM look),
flips AS (SELECT *, CAST(sum(CASE WHEN opens AND NOT holds THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nflip
  FROM acts {W}),
codes AS (SELECT *, max(CASE WHEN NOT is_gap AND opens = holds
    THEN rn * 2 + (CAST(opens AS BIGINT) + nflip) % 2 END) OVER w AS code FROM flips {W}),
states AS (SELECT *, (coalesce(code, 0) + nflip) % 2 = 1 AS busy_after FROM codes),
states2 AS (SELECT *, coalesce(lag(busy_after) OVER w, false) AS busy FROM states {W}),
marks AS (SELECT *, NOT busy AND fast AND NOT is_gap AS starts, busy AND NOT is_gap AND q1 AS closes FROM states2),
raws AS (SELECT *, CASE
    WHEN coalesce(lead(closes) OVER w, false) THEN 'Saccade_End' WHEN is_gap THEN gap
    WHEN starts AND q2 THEN 'Saccade_End' WHEN starts AND final THEN 'Saccade'
    WHEN starts THEN 'Saccade_Start' WHEN busy AND NOT closes THEN 'Saccade'
    WHEN coalesce(lag(starts AND NOT q2) OVER w, false) THEN 'Saccade' ELSE 'Unknown' END AS raw
  FROM marks {W}),
events_labelled AS (SELECT *, CASE
    WHEN raw = 'Saccade_End' AND rn > 1 AND lag(raw) OVER w <> 'Saccade' THEN 'Noise'
    WHEN raw = 'Saccade_Start' AND coalesce(lead(raw) OVER w, '') = 'Saccade_End' THEN 'Noise'
    ELSE raw END AS event FROM raws {W})
"""
SMOOTHED = EVENTS + f""",
mode AS (SELECT *, coalesce(max(CASE WHEN event IN ('Saccade_Start', 'Saccade_End')
     THEN rn * 2 + CASE WHEN event = 'Saccade_End' THEN 1 ELSE 0 END END) OVER w % 2, 1) = 1 AS inside
  FROM events_labelled {W}),
opening AS (SELECT *, rn = 1 OR (NOT inside AND coalesce(lead(event) OVER w, '') = 'Saccade_End') AS opens_seg
  FROM mode {W}),
segs AS (SELECT *, max(CASE WHEN opens_seg THEN rn END) OVER w AS seg_start,
    inside OR opens_seg AS member FROM opening {W}),
smoothed AS (SELECT *,
    CASE WHEN member AND rn - seg_start >= 4 THEN
      (lag(px, 3) OVER w + lag(px, 2) OVER w * exp(-1 / 128e0) + lag(px, 1) OVER w * exp(-4 / 128e0)
       + px * exp(-9 / 128e0)) / (1 + exp(-1 / 128e0) + exp(-4 / 128e0) + exp(-9 / 128e0)) ELSE px END AS sx,
    CASE WHEN member AND rn - seg_start >= 4 THEN
      (lag(py, 3) OVER w + lag(py, 2) OVER w * exp(-1 / 128e0) + lag(py, 1) OVER w * exp(-4 / 128e0)
       + py * exp(-9 / 128e0)) / (1 + exp(-1 / 128e0) + exp(-4 / 128e0) + exp(-9 / 128e0)) ELSE py END AS sy
  FROM segs {W})
"""


def _fix_sql(source: str, x: str, y: str) -> str:
    return f""",
steps AS (SELECT *, rn = 1 OR coalesce(sqrt(pow({x} - lag({x}) OVER w, 2) + pow({y} - lag({y}) OVER w, 2)) < 25,
    false) AS near FROM {source} {W}),
anchors AS (SELECT *, max(CASE WHEN near THEN rn END) OVER (PARTITION BY recording_id ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM steps),
islands AS (SELECT *, rn > 1 AND NOT near AND (rn - anchor) % 2 = 1 AS breaks,
    max(CASE WHEN rn = 1 OR (rn - 1 - anchor) % 2 = 1 THEN rn END) OVER w AS fixation_id FROM anchors {W}),
fix AS (SELECT recording_id, fixation_id, min(t_ms) AS start_ms, max(t_ms) AS end_ms,
    max(t_ms) - min(t_ms) AS duration_ms, count(*) AS n,
    sum((rn - fixation_id + 1) * {x}) / (count(*) * (count(*) + 1) / 2) AS mean_x,
    sum((rn - fixation_id + 1) * {y}) / (count(*) * (count(*) + 1) / 2) AS mean_y
  FROM islands WHERE NOT breaks GROUP BY 1, 2 HAVING max(t_ms) - min(t_ms) >= 50)
"""


FIX_OUT = """SELECT recording_id, fixation_id, round(start_ms, 6) AS start_ms, round(end_ms, 6) AS end_ms,
  round(duration_ms, 6) AS duration_ms, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM fix"""


def _slow(text: str) -> str:
    return text.replace("@samples@", "gaze_samples")


def _fast(text: str) -> str:
    return text.replace("@samples@", "fast_gaze_samples")


def _fix_columns(fix):
    return fix.select(
        "recording_id", "fixation_id", r6("start_ms").alias("start_ms"), r6("end_ms").alias("end_ms"),
        r6("duration_ms").alias("duration_ms"), "n", r6("mean_x").alias("mean_x"),
        r6("mean_y").alias("mean_y"),
    )


@query(
    "gaze_valid_eye",
    "SELECT recording_id, sample_id, left_valid, right_valid FROM gaze_samples WHERE left_valid = 1 OR right_valid = 1",
    ("gaze_samples",),
)
def _(t):
    return gaze.valid_eye(t["gaze_samples"]).select("recording_id", "sample_id", "left_valid", "right_valid")


@query(
    "gaze_binocular_merge",
    _slow(POINTS) + "SELECT recording_id, sample_id, round(gaze_x, 6) AS gaze_x, round(gaze_y, 6) AS gaze_y FROM merged",
    ("gaze_samples",),
)
def _(t):
    return gaze.merge_eyes(t["gaze_samples"]).select(
        "recording_id", "sample_id", r6("gaze_x").alias("gaze_x"), r6("gaze_y").alias("gaze_y")
    )


@query(
    "gaze_binocular_merge_carry_forward",
    """WITH tagged AS (SELECT *,
    CASE WHEN left_x IS NOT NULL AND left_y IS NOT NULL AND right_x IS NOT NULL AND right_y IS NOT NULL
         THEN struct_pack(x := (left_x + right_x) / 2, y := (left_y + right_y) / 2)
         WHEN left_x IS NULL AND left_y IS NULL THEN struct_pack(x := right_x, y := right_y)
         WHEN right_x IS NULL AND right_y IS NULL THEN struct_pack(x := left_x, y := left_y) END AS p
  FROM gaze_samples),
held AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY device_us, sample_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM tagged)
SELECT recording_id, sample_id, round(q.x, 6) AS gaze_x, round(q.y, 6) AS gaze_y FROM held""",
    ("gaze_samples",),
)
def _(t):
    merged = gaze.merge_eyes(t["gaze_samples"], True)
    return merged.select(
        "recording_id", "sample_id", r6("gaze_x").alias("gaze_x"), r6("gaze_y").alias("gaze_y")
    )


@query(
    "gaze_on_screen",
    _slow(POINTS) + "SELECT recording_id, count(*) AS n FROM shown GROUP BY 1",
    ("gaze_samples",),
)
def _(t):
    kept = gaze.on_screen(gaze.merge_eyes(t["gaze_samples"]))
    return kept.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gaze_pixels_and_time",
    _slow(POINTS) + "SELECT recording_id, sample_id, rn, px, py, round(t_ms, 6) AS t_ms FROM points",
    ("gaze_samples",),
)
def _(t):
    p = gaze.pixel_points(t["gaze_samples"])
    return p.select("recording_id", "sample_id", "rn", "px", "py", r6("t_ms").alias("t_ms"))


@query(
    "gaze_outlier_repair",
    _slow(REPAIRED) + "SELECT recording_id, sample_id, px, py FROM repaired",
    ("gaze_samples",),
)
def _(t):
    blocks = gaze.blocked(gaze.pixel_points(t["gaze_samples"]))
    return gaze.repair_outliers(blocks).filter("own").select("recording_id", "sample_id", "px", "py")


@query(
    "gaze_motion_and_gaps",
    _slow(MOTION) + "SELECT recording_id, sample_id, round(isd_ms, 6) AS isd_ms, round(velocity, 6) AS velocity, gap FROM gaps",
    ("gaze_samples",),
)
def _(t):
    signal = gaze.clean_signal(t["gaze_samples"])
    return signal.filter("own").select(
        "recording_id", "sample_id", r6("isd_ms").alias("isd_ms"), r6("velocity").alias("velocity"), "gap"
    )


@query(
    "gaze_event_labels",
    _fast(EVENTS) + "SELECT recording_id, sample_id, event FROM events_labelled",
    ("fast_gaze_samples",),
)
def _(t):
    signal = cut(gaze.clean_signal(t["fast_gaze_samples"]))
    return gaze.label_events(signal).filter("own").select("recording_id", "sample_id", "event")


@query(
    "gaze_smoothing",
    _fast(SMOOTHED) + "SELECT recording_id, sample_id, round(sx, 6) AS sx, round(sy, 6) AS sy FROM smoothed",
    ("fast_gaze_samples",),
)
def _(t):
    signal = cut(gaze.clean_signal(t["fast_gaze_samples"]))
    out = gaze.smooth(gaze.label_events(signal))
    return out.filter("own").select("recording_id", "sample_id", r6("sx").alias("sx"), r6("sy").alias("sy"))


@query(
    "gaze_fixations",
    _slow(POINTS) + _fix_sql("points", "px", "py") + FIX_OUT,
    ("gaze_samples",),
)
def _(t):
    points = cut(gaze.pixel_points(t["gaze_samples"]))
    blocks = ordered.with_halo(points, 2)
    return _fix_columns(gaze.fixations(blocks))


@query(
    "gaze_fixations_full_chain",
    _fast(SMOOTHED) + _fix_sql("smoothed", "sx", "sy") + FIX_OUT,
    ("fast_gaze_samples",),
)
def _(t):
    return _fix_columns(gaze.detect_fixations(t["fast_gaze_samples"]))


SUMMARY = """SELECT s.recording_id, coalesce(f.n, 0) AS n_fixations,
  round(coalesce(f.total, 0), 6) AS total_duration_ms, round(f.total / f.n, 6) AS mean_duration_ms,
  round(CASE WHEN s.span > 0 THEN coalesce(f.n, 0) / (s.span / 1000) END, 6) AS fixations_per_s
FROM (SELECT recording_id, max(t_ms) AS span FROM points GROUP BY 1) s
LEFT JOIN (SELECT recording_id, count(*) AS n, sum(duration_ms) AS total FROM fix GROUP BY 1) f
  ON s.recording_id = f.recording_id"""


@query(
    "gaze_fixation_summary",
    _slow(POINTS) + _fix_sql("points", "px", "py") + SUMMARY,
    ("gaze_samples",),
)
def fixation_summary(t):
    # The points feed the summary, the blocks and their carries: written once.
    points = cut(gaze.pixel_points(t["gaze_samples"]))
    blocks = ordered.with_halo(points, 2)
    out = gaze.fixation_summary(points, gaze.fixations(blocks))
    return out.select(
        "recording_id", "n_fixations", *[r6(c).alias(c) for c in out.columns[2:]]
    )
