"""Streaming queries over the event table, run until the data is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.plans.gaze_plans import EVENTS, MOTION, POINTS, _fix_sql
from ocuspark.plans.registry import query
from ocuspark.sources import adapters
from ocuspark.streaming import live


def _events(t):
    """The event file as a stream (its schema comes from the table itself)."""
    # A glob, because a stream's plain path must be a folder; it matches a single
    # file as well as a folder of part files.
    path = f"{t.sf_dir}/events.parque[t]"
    return t.spark.readStream.schema(t["events"].schema).parquet(path)


def _samples(t, name: str = "gaze_samples"):
    text = adapters._fill(adapters.TABLES[name], adapters.SPARK_WORDS)
    return live.with_event_time(t.spark.sql(text, events=_events(t)))


G = ("gaze_samples",)


@query(
    "stream_clean_points",
    POINTS.replace("@samples@", "gaze_samples") + "SELECT recording_id, sample_id, device_us, px, py FROM points",
    G,
)
def _(t):
    points = live.clean(_samples(t)).select("recording_id", "sample_id", "device_us", "px", "py")
    return live.run_available(points)


# Parts of a recording between pauses of over a second, as recordings of their own.
PARTS = """
paused AS (SELECT *, CAST(sum(CASE WHEN device_us - before > 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY rn) AS BIGINT) AS part
  FROM (SELECT *, lag(device_us) OVER (PARTITION BY recording_id ORDER BY rn) AS before, max(device_us) OVER (PARTITION BY recording_id) AS rec_last FROM @rows@ WHERE device_us <= (SELECT (max(device_us) // 1000 - 2000) * 1000 FROM @rows@)) p),
parts AS (SELECT * EXCLUDE (recording_id, rn), recording_id * 1000000 + part AS recording_id,
  row_number() OVER (PARTITION BY recording_id, part ORDER BY rn) AS rn, count(*) OVER (PARTITION BY recording_id, part) AS n,
  max(device_us) OVER (PARTITION BY recording_id, part) AS last FROM paused)
"""


# A detector takes the samples that the watermark (two seconds behind the latest sample, in
# whole milliseconds) has passed, and finishes what is open at a pause and when the watermark
# passes a second after the last sample.
MARK = "(SELECT (max(device_us) // 1000 - 2000) * 1000 FROM @rows@)"


LIVE_FIX = (
    POINTS.replace("@samples@", "gaze_samples").rstrip() + "," + PARTS.replace("@rows@", "points")
    + _fix_sql("parts", "px", "py").replace("HAVING", f""", recording_id, fixation_id
      HAVING (max(rn) < max(n) OR max(device_us) < max(rec_last)
        OR max(device_us) + 1000000 <= {MARK.replace("@rows@", "points")}) AND""").replace(
        "min(t_ms) AS start_ms, max(t_ms) AS end_ms", "min(device_us) AS start_us, max(device_us) AS end_us, max(rn) AS last_rn").replace("count(*) AS n,", "count(*) AS size,")
)


@query(
    "stream_live_fixations",
    LIVE_FIX + "SELECT recording_id // 1000000 AS recording_id, start_us, end_us, size AS n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM fix",
    G,
)
def _(t):
    fixations = live.run_available(live.live_fixations(live.clean(_samples(t))))
    return fixations.withColumns({c: F.round(c, 6) for c in ("mean_x", "mean_y")}).drop("closed_at")


@query(
    "stream_live_events",
    """WITH signal AS (SELECT user_id AS recording_id, event_id AS sample_id, device_us, value AS velocity,
      CASE WHEN event_id % 17 = 0 THEN 'Blink_End' END AS gap, row_number() OVER (PARTITION BY user_id ORDER BY device_us, event_id) AS rn
      FROM (SELECT *, CAST(floor((epoch_us(ts) - 1704067200000000) / 400000) AS BIGINT) AS device_us FROM events) e),"""
    + PARTS.replace("@rows@", "signal") + ", gaps AS (SELECT * FROM parts)"
    + EVENTS[len(MOTION):] + """SELECT recording_id // 1000000 AS recording_id, sample_id, device_us, event FROM events_labelled
      WHERE rn <= n - 3 OR last < rec_last OR last + 1000000 <= """ + MARK.replace("@rows@", "signal"),
)
def _(t):
    # A stand-in signal: the value column as velocity, time compressed as in the gaze table.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _events(t).select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("sample_id"),
        F.floor((us - 1704067200000000) / 400000).cast("bigint").alias("device_us"),
        F.col("value").alias("velocity"),
        F.when(F.col("event_id") % 17 == 0, F.lit("Blink_End")).alias("gap"),
    )
    return live.run_available(live.live_events(live.with_event_time(e)))


def _micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


# Windows are emitted once the watermark (largest event time minus the delay)
# has passed their end. Sessions that touch are one, so a pause of just the gap does not end it.
@query(
    "stream_recording_sessions",
    """WITH g AS (SELECT recording_id, device_us, device_us - lag(device_us) OVER w AS gap FROM gaze_samples
      WINDOW w AS (PARTITION BY recording_id ORDER BY device_us, sample_id)),
    s AS (SELECT *, sum(CASE WHEN gap <= 200000 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY device_us) AS k FROM g)
    SELECT recording_id, min(device_us) AS session_start, max(device_us) + 200000 AS session_end, count(*) AS n_samples FROM s
    GROUP BY recording_id, k
    HAVING max(device_us) + 200000 <= (SELECT (max(device_us) // 1000 - 2000) * 1000 FROM gaze_samples)""",
    G,
)
def _(t):
    sessions = live.run_available(live.recording_sessions(_samples(t)))
    return _micros(sessions, "session_start", "session_end")


def _hits(t):
    e = _events(t).select(
        F.col("ts").cast("timestamp").alias("event_time"),
        (F.col("event_type") == "click").alias("hit"),
    )
    return e.withWatermark("event_time", "10 minutes")


def _rate_sql(hours: int) -> str:
    return f"""WITH h AS (SELECT (epoch_us(ts) // 3600000000) - unnest(range({hours})) AS hour, event_type = 'click' AS hit FROM events)
    SELECT hour * 3600000000 AS window_start, (hour + {hours}) * 3600000000 AS window_end, count(*) AS n_fixations,
      round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM h GROUP BY hour
    HAVING (hour + {hours}) * 3600000000 <= (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events)"""


def _rates(t, length: str, slide: str | None = None):
    rates = live.run_available(live.hit_rates(_hits(t), length, slide))
    return _micros(rates, "window_start", "window_end").withColumn("hit_rate", F.round("hit_rate", 6))


@query("stream_hit_rate_tumbling", _rate_sql(1))
def _(t):
    return _rates(t, "1 hour")


@query("stream_hit_rate_sliding", _rate_sql(2))
def _(t):
    return _rates(t, "2 hours", "1 hour")


@query(
    "stream_unique_uploads",
    "SELECT DISTINCT sha256(concat_ws('|', user_id, event_type)) AS sha256 FROM events",
)
def _(t):
    e = _events(t).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.sha2(F.concat_ws("|", "user_id", "event_type"), 256).alias("sha256"),
    )
    uploads = live.unique_uploads(e.withWatermark("event_time", "1 hour"))
    return live.run_available(uploads).select("sha256")


def _aoi_sql(seconds: int) -> str:
    """A fixation is closed by the sample that breaks it or a second after its last; it counts in the windows of that time."""
    return LIVE_FIX + f""", closed AS (SELECT f.recording_id // 1000000 % 500 AS screen_id, f.mean_x, f.mean_y, coalesce(i.device_us, f.end_us + 1000000) AS closed_us
      FROM fix f LEFT JOIN islands i ON i.recording_id = f.recording_id AND i.rn = f.last_rn + 1),
    aoi AS (SELECT closed_us // 1000000 - unnest(range({seconds})) AS second, EXISTS (SELECT 1 FROM elements e WHERE e.screen_id = c.screen_id
      AND c.mean_x BETWEEN e.x AND e.x + e.w AND c.mean_y BETWEEN e.y AND e.y + e.h) AS hit FROM closed c)
    SELECT second * 1000000 AS window_start, (second + {seconds}) * 1000000 AS window_end, count(*) AS n_fixations,
      round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM aoi GROUP BY second
    HAVING (second + {seconds}) * 1000000 <= {MARK.replace("@rows@", "points")}"""


def _aoi_rates(t, length: str, slide: str | None = None):
    shown = t["events"].select(F.col("user_id").alias("recording_id"), (F.col("user_id") % 500).alias("screen_id")).distinct()
    hits = live.aoi_hits(live.live_fixations(live.clean(_samples(t))), shown, t["elements"])
    rates = live.run_available(live.hit_rates(hits, length, slide, time="closed_at"))
    return _micros(rates, "window_start", "window_end").withColumn("hit_rate", F.round("hit_rate", 6))


@query("stream_aoi_hit_rate_tumbling", _aoi_sql(1), ("gaze_samples", "elements"))
def _(t):
    return _aoi_rates(t, "1 second")


@query("stream_aoi_hit_rate_sliding", _aoi_sql(2), ("gaze_samples", "elements"))
def _(t):
    return _aoi_rates(t, "2 seconds", "1 second")
