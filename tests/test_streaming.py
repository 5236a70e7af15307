"""The live detectors give the batch results, whatever the micro-batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ocuspark.operators import gaze, ordered
from ocuspark.streaming import live

SCHEMA = "recording_id long, sample_id long, device_us long, px double, py double, velocity double, gap string"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for rec, n in ((1, 120), (2, 45), (3, 6)):
        x = y = 200.0
        for i in range(n):
            if rng.random() < 0.2:
                x, y = rng.uniform(0, 880), rng.uniform(0, 680)
            v = rng.choice([0.0, 60.0, 60.0]) if i else 0.0
            g = rng.choice([None] * 9 + ["Blink_End"])
            rows.append((rec, i, 1_000_000_000 + 20_000 * i, x + rng.uniform(-3, 3), y, v, g))
    # A much later sample of another recording lets every timer run out.
    rows.append((99, 0, 1_060_000_000, 1.0, 1.0, 0.0, None))
    folder = str(tmp_path_factory.mktemp("stream"))
    df = spark.createDataFrame(rows, SCHEMA)
    for part, (lo, hi) in enumerate(((0, 1_000_500_000), (1_000_500_000, 1_001_500_000), (1_001_500_000, 10**12))):
        df.filter((F.col("device_us") >= lo) & (F.col("device_us") < hi)).coalesce(1).write.parquet(
            f"{folder}/f{part}"
        )
    return df.filter("recording_id < 99"), folder


def stream(spark, folder):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/f*")
    return live.with_event_time(s)


def test_live_fixations_equal_batch(spark, files):
    df, folder = files
    got = live.run_available(live.live_fixations(stream(spark, folder))).collect()
    points = gaze.with_position(df)
    batch = gaze.fixations(ordered.with_halo(points, 2)).collect()
    a = sorted((r.recording_id, r.start_us / 1000 - 1e6, r.n, round(r.mean_x, 6)) for r in got)
    b = sorted((r.recording_id, r.start_ms, r.n, round(r.mean_x, 6)) for r in batch)
    assert a == b and len(a) > 5


def test_live_events_equal_batch(spark, files):
    df, folder = files
    got = live.run_available(live.live_events(stream(spark, folder))).collect()
    blocks = gaze.blocked(gaze.with_position(df))
    batch = gaze.label_events(blocks).filter("own").collect()
    a = {(r.recording_id, r.sample_id): r.event for r in got if r.recording_id < 99}
    b = {(r.recording_id, r.sample_id): r.event for r in batch}
    assert a == b


def test_duplicate_uploads_are_dropped(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 3)]
    df = spark.createDataFrame(rows, "sha256 string, s long")
    df.withColumn("event_time", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "u"))
    s = spark.readStream.schema("sha256 string, event_time timestamp").parquet(str(tmp_path / "u"))
    out = live.run_available(live.unique_uploads(s.withWatermark("event_time", "1 hour")))
    assert sorted(r.sha256 for r in out.collect()) == ["a", "b"]


@pytest.mark.parametrize("parts", [1, 2, 4, 10])
def test_pauses_end_what_is_open_however_files_are_split(spark, tmp_path, parts):
    """Pauses of five seconds inside a fixation and inside a saccade."""
    rng = random.Random(4)
    rows, us = [], 1_000_000_000
    for i in range(200):
        us += 5_000_000 if i % 50 == 49 else 20_000
        rows.append((1, i, us, 100.0 + rng.uniform(-3, 3), 100.0, 60.0 if i % 50 > 40 or i % 50 < 4 else 0.0, None))
    rows.append((99, 0, us + 60_000_000, 1.0, 1.0, 0.0, None))
    df = spark.createDataFrame(rows, SCHEMA)
    size = -(-len(rows) // parts)
    for k in range(parts):
        ids = [r[:2] for r in rows[k * size : (k + 1) * size]]
        if ids:
            part = spark.createDataFrame(ids, "recording_id long, sample_id long")
            df.join(part, ["recording_id", "sample_id"]).select(df.columns).coalesce(1).write.parquet(f"{tmp_path}/f{k:02d}")
    fix = live.run_available(live.live_fixations(stream(spark, tmp_path))).collect()
    times = [r[2] for r in rows[:200]]
    edges = [0, *(i for i in range(1, 200) if times[i] - times[i - 1] > 1_000_000), 200]
    assert sorted((r.start_us, r.end_us, r.n) for r in fix) == [(times[a], times[b - 1], b - a) for a, b in zip(edges, edges[1:]) if times[b - 1] - times[a] >= 50_000]
    events = live.run_available(live.live_events(stream(spark, tmp_path))).collect()
    want = {}
    for a, b in zip(edges, edges[1:]):
        labels, _ = live.label_run([r[5] for r in rows[a:b]], [""] * (b - a), False, True, True)
        want |= dict(zip(range(a, b), labels))
    assert {r.sample_id: r.event for r in events if r.recording_id == 1} == want


@pytest.mark.parametrize("order", ["forward", "backward", "dealt"])
def test_files_in_any_order_within_the_delay_give_the_batch_result(spark, tmp_path, order):
    """One and a half seconds of samples over files that arrive forward, backward, or with every file holding every fifth sample."""
    rng = random.Random(8)
    rows, x = [], 200.0
    for i in range(75):
        x = rng.uniform(0, 800) if rng.random() < 0.15 else x
        rows.append((1, i, 1_000_000_000 + 20_000 * i, x + rng.uniform(-3, 3), 100.0, rng.choice([0.0, 60.0, 60.0]) if i else 0.0, rng.choice([None] * 9 + ["Blink_End"])))
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [rows[15 * k : 15 * k + 15] for k in range(5)]
    parts = {"forward": parts, "backward": parts[::-1], "dealt": [rows[k::5] for k in range(5)]}[order]
    # The last sample lets the timers run out.
    for k, part in enumerate([*parts, [(99, 0, 1_060_000_000, 1.0, 1.0, 0.0, None)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/f{k}")
        time.sleep(0.02)  # files are read by age
    got = live.run_available(live.live_fixations(stream(spark, tmp_path))).collect()
    batch = gaze.fixations(ordered.with_halo(gaze.with_position(df), 2)).collect()
    assert sorted((r.start_us / 1000 - 1e6, r.n, round(r.mean_x, 6)) for r in got) == sorted((r.start_ms, r.n, round(r.mean_x, 6)) for r in batch)
    assert len(got) > 3
    events = live.run_available(live.live_events(stream(spark, tmp_path))).filter("recording_id = 1").collect()
    labels, _ = live.label_run([r[5] for r in rows], [r[6] or "" for r in rows], False, True, True)
    assert {r.sample_id: r.event for r in events} == dict(enumerate(labels))


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_aoi_hit_rates_do_not_depend_on_the_files(spark, tmp_path, parts):
    """Detector, stream-static join and windows in one query, beside the batch fixations and a loop over the elements."""
    rng = random.Random(3)
    rows = []
    for rec in (1, 2, 3):
        x = y = 100.0
        for i in range(300):
            if rng.random() < 0.1:
                x, y = rng.uniform(0, 300), rng.uniform(0, 300)
            rows.append((rec, i, 1_000_000_000 + 20_000 * i, x + rng.uniform(-3, 3), y, 0.0, None))
    rows.sort(key=lambda r: r[2])
    size = -(-len(rows) // parts)
    for k, part in enumerate([*(rows[i : i + size] for i in range(0, len(rows), size)), [(99, 0, 1_060_000_000, 1.0, 1.0, 0.0, None)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/f{k:02d}")
        time.sleep(0.02)
    shown = spark.createDataFrame([(1, 7), (2, 8)], "recording_id long, screen_id long")
    boxes = [(s, rng.randrange(300), rng.randrange(300), rng.randrange(1, 90), rng.randrange(1, 90)) for s in (7, 8) for _ in range(12)] + [(7, 64, 64, 64, 64)] * 2
    elements = spark.createDataFrame(boxes, "screen_id long, x int, y int, w int, h int")
    fixations = live.live_fixations(stream(spark, tmp_path))
    got = live.run_available(live.hit_rates(live.aoi_hits(fixations, shown, elements), "2 seconds", "1 second", time="closed_at")).collect()
    batch = gaze.fixations(ordered.with_halo(gaze.with_position(spark.createDataFrame(rows, SCHEMA)), 2)).collect()
    want = {}
    times = [1_000_000_000 + 20_000 * i for i in range(300)]
    for r in batch:
        end = round(r.end_ms * 1000) + 1_000_000_000 if r.end_ms < 1e6 else round(r.end_ms * 1000)
        closed = next((t for t in times if t > end), end + 1_000_000)
        screen = {1: 7, 2: 8}.get(r.recording_id)
        hit = any(s == screen and x <= r.mean_x <= x + w and y <= r.mean_y <= y + h for s, x, y, w, h in boxes)
        for second in (closed // 10**6, closed // 10**6 - 1):
            want.setdefault(second, []).append(hit)
    assert {r.window_start.timestamp(): (r.n_fixations, round(r.hit_rate, 9)) for r in got} == {float(s): (len(v), round(sum(v) / len(v), 9)) for s, v in want.items()}
    assert 0 < sum(sum(v) for v in want.values()) < sum(map(len, want.values()))


def test_a_pause_of_just_the_gap_does_not_end_a_session(spark, tmp_path):
    """The query and its SQL, on pauses of 199,999, 200,000 and 200,001 microseconds."""
    import duckdb

    from ocuspark.plans.catalog import CHECKS, QUERIES

    us, times = 0, []
    for pause in (0, 199_999, 200_000, 200_001, 200_000, 9_000_000):
        us += pause
        times.append(us)
    rows = ", ".join(f"({i}, make_timestamp({1704067200000000 + 400_000 * t}), 7, 'view', 1e0, '{{\"k\": 1}}')" for i, t in enumerate(times))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, e AS value, f AS props FROM (VALUES {rows}) v(a, b, c, d, e, f)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    name = "stream_recording_sessions"
    found = QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.select("recording_id", "session_start", "session_end", "n_samples").collect())
    assert got == sorted(con.execute(CHECKS[name]).fetchall()) and [r[3] for r in got] == [3, 2]


def test_samples_at_device_time_zero_and_before_are_kept(spark, tmp_path):
    rows = [(rec, i, us, 100.0, 100.0, 60.0, None) for rec, first in ((1, 0), (2, -20_000)) for i, us in enumerate(range(first, 100_000, 20_000))]
    rows.append((99, 0, 60_000_000, 1.0, 1.0, 0.0, None))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/f0")
    fix = live.run_available(live.live_fixations(stream(spark, tmp_path))).collect()
    assert sorted((r.recording_id, r.start_us, r.n) for r in fix) == [(1, 0, 5), (2, -20_000, 6)]
    events = live.run_available(live.live_events(stream(spark, tmp_path))).collect()
    assert sorted((r.recording_id, r.sample_id) for r in events if r.recording_id < 99) == [r[:2] for r in rows[:-1]]


def test_only_shown_screens_are_cut_into_tiles(spark, monkeypatch):
    elements = spark.createDataFrame([(s, 10 * s, 0, 20, 20) for s in range(50)], "screen_id long, x int, y int, w int, h int")
    shown = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "recording_id long, screen_id long")
    fixations = spark.createDataFrame([(1, 75.0, 5.0), (2, 75.0, 5.0), (3, 5.0, 5.0), (4, 75.0, 5.0)], "recording_id long, mean_x double, mean_y double")
    made, tiles = [], live.aoi_tiles
    monkeypatch.setattr(live, "aoi_tiles", lambda e, size: made.append(tiles(e, size)) or made[0])
    hits = live.aoi_hits(fixations, shown, elements).collect()
    assert {r.recording_id: r.hit for r in hits} == {1: True, 2: False, 3: False, 4: False}
    assert {r.screen_id for r in made[0].collect()} == {7, 8}
