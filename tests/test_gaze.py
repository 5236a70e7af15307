"""Blocked gaze operators against plain sequential loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ocuspark.operators import gaze, ordered
from ocuspark.operators.buckets import add_order_chunk
from ocuspark.streaming.live import label_run


def loop_events(v, gap):
    """Replay the detector as a list of label writes; later writes win."""
    n, busy, writes = len(v), False, {}
    for row, (speed, pause) in enumerate(zip(v, gap)):
        if pause:
            writes[row] = pause
            continue
        opened = speed > 40 and not busy
        at = min(row + 1, n - 1) if opened else row
        if opened:
            writes[row] = "Saccade_Start"
        if opened or busy:
            calm = at + 1 < n and v[at + 1] <= 40
            writes[at - 1 if calm else at] = "Saccade_End" if calm else "Saccade"
            busy = not calm
    raw = [writes.get(i, "Unknown") for i in range(n)]
    lone = [e == "Saccade_End" and i > 0 and raw[i - 1] != "Saccade" for i, e in enumerate(raw)]
    empty = [
        e == "Saccade_Start" and raw[i + 1 : i + 2] == ["Saccade_End"] for i, e in enumerate(raw)
    ]
    return ["Noise" if a or b else e for e, a, b in zip(raw, lone, empty)]


def loop_smooth(p, lab):
    """Segments by walking; a start on a segment's first row does not end it."""
    n, out = len(p), list(p)
    weights = [math.exp(-k * k / 128) for k in range(4)]

    def apply(a, b):
        for i in range(a + 4, b):
            out[i] = sum(w * p[i - 3 + k] for k, w in enumerate(weights)) / sum(weights)

    start, i = 0, 0
    while i < n:
        if lab[i] == "Saccade_Start" and i > start:
            apply(start, i)
            j = i + 1
            while j < n and lab[j] != "Saccade_End":
                j += 1
            start = j - 1
            i = start + 1
        else:
            i += 1
    apply(start, n)
    return out


def loop_fixations(x, y, t):
    found, cur = [], []
    for i in range(len(x) + 1):
        if i < len(x) and (
            not cur or math.hypot(x[i] - x[cur[-1]], y[i] - y[cur[-1]]) < 25
        ):
            cur.append(i)
            continue
        if cur and t[cur[-1]] - t[cur[0]] >= 50:
            w = sum(range(1, len(cur) + 1))
            found.append(
                (
                    t[cur[0]],
                    t[cur[-1]],
                    len(cur),
                    sum((k + 1) * x[c] for k, c in enumerate(cur)) / w,
                    sum((k + 1) * y[c] for k, c in enumerate(cur)) / w,
                )
            )
        cur = []
    return found


def traces(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for rec, n in enumerate(sizes):
        x = y = 300.0
        us = rng.randrange(1000)
        for i in range(n):
            if rng.random() < 0.25:
                x, y = rng.uniform(0, 880), rng.uniform(0, 680)
            else:
                x, y = x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)
            us += rng.choice([4000, 4000, 4000, 0, 20000, 150_000, 300_000])
            v = rng.choice([0.0, 5.0, 60.0, 60.0, 41.0])
            g = rng.choice([None] * 8 + ["Blink_End", "Noise_End"])
            rows.append((rec, i, us, float(x), float(y), v, g))
    return rows


SCHEMA = "recording_id long, sample_id long, device_us long, px double, py double, velocity double, gap string"


@pytest.fixture(scope="module")
def trace_rows():
    # Recording 0 holds well over a third of all samples.
    return traces(1, [700, 90, 60, 45, 33, 17, 5, 2, 1] + [40] * 12)


@pytest.fixture(scope="module")
def numbered(spark, trace_rows):
    df = spark.createDataFrame(trace_rows, SCHEMA)
    return gaze.with_position(df).checkpoint()


def test_one_timestamp_for_most_samples(spark):
    """A timestamp that fills many buckets is cut by the sample id."""
    rows = [(1, i, 5_000, 0.0, 0.0, 0.0, None) for i in range(400)]
    rows += [(1, i, 9_000 - i, 0.0, 0.0, 0.0, None) for i in range(400, 450)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    got = gaze.with_position(df).orderBy("rn").collect()
    assert [r.sample_id for r in got] == want
    assert [r.rn for r in got] == list(range(1, 451))
    chunks = add_order_chunk(df, "device_us", "sample_id", "c").groupBy("c").count()
    assert chunks.agg(F.max("count")).first()[0] < 250


def by_recording(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_numbers_follow_time(numbered, trace_rows):
    want = {
        (rec, r[1]): k + 1 for rec, rs in by_recording(trace_rows).items() for k, r in enumerate(rs)
    }
    got = {(r.recording_id, r.sample_id): r.rn for r in numbered.collect()}
    assert got == want


@pytest.mark.parametrize("block_rows", [33, 64, 100_000])
def test_events_equal_loop(numbered, trace_rows, block_rows):
    labelled = gaze.label_events(gaze.blocked(numbered, block_rows), block_rows)
    got = {(r.recording_id, r.rn): r.event for r in labelled.filter("own").collect()}
    for rec, rs in by_recording(trace_rows).items():
        want = loop_events([r[5] for r in rs], [r[6] for r in rs])
        assert [got[rec, k + 1] for k in range(len(rs))] == want


def test_stream_labeller_equals_loop():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(1, 14)
        v = [0.0] + [rng.choice([5.0, 60.0]) for _ in range(n - 1)]
        g = [rng.choice(["", "", "", "", "Blink_End"]) for _ in range(n)]
        assert label_run(v, g, False, True, True)[0] == loop_events(v, g)


def events_of(spark, velocities):
    rows = [(1, i, 4000 * i, 0.0, 0.0, float(v), None) for i, v in enumerate(velocities)]
    points = gaze.with_position(spark.createDataFrame(rows, SCHEMA))
    out = gaze.label_events(gaze.blocked(points)).filter("own").orderBy("rn").collect()
    return [r.event for r in out]


def test_known_event_traces(spark):
    u, n = "Unknown", "Noise"
    assert events_of(spark, [0, 60, 60, 60, 60, 5, 5]) == [
        u, "Saccade_Start", "Saccade", "Saccade_End", u, u, u,
    ]
    assert events_of(spark, [0, 60, 60, 5, 5]) == [u, n, n, u, u]


def test_smoothing_equals_loop(numbered, trace_rows):
    rng = random.Random(9)
    labels = {}
    for rec, rs in by_recording(trace_rows).items():
        for k in range(len(rs)):
            labels[rec, k + 1] = rng.choice(["Unknown"] * 12 + ["Saccade_Start", "Saccade_End"])
    spark = numbered.sparkSession
    ev = spark.createDataFrame(
        [(a, b, e) for (a, b), e in labels.items()], "recording_id long, rn long, event string"
    )
    blocks = gaze.blocked(numbered.join(ev, ["recording_id", "rn"]), 33)
    got = {
        (r.recording_id, r.rn): (r.sx, r.sy)
        for r in gaze.smooth(blocks, 33).filter("own").collect()
    }
    for rec, rs in by_recording(trace_rows).items():
        lab = [labels[rec, k + 1] for k in range(len(rs))]
        if lab[0] == "Saccade_Start":
            continue  # foreign label on the first row: only termination is promised
        # A start right before an end is the first row of the new segment.
        for axis, col in ((0, 3), (1, 4)):
            want = loop_smooth([r[col] for r in rs], lab)
            have = [got[rec, k + 1][axis] for k in range(len(rs))]
            assert have == pytest.approx(want, abs=1e-9)


def test_foreign_labels_terminate(spark):
    rows = [(1, i, 4000 * i, float(i), 0.0, 0.0, None) for i in range(3)]
    points = gaze.with_position(spark.createDataFrame(rows, SCHEMA))
    labels = F.element_at(
        F.array(F.lit("Saccade_Start"), F.lit("Saccade"), F.lit("Saccade_End")), F.col("rn").cast("int")
    )
    out = gaze.smooth(gaze.blocked(points.withColumn("event", labels))).filter("own")
    assert out.count() == 3


@pytest.mark.parametrize("block_rows", [33, 100_000])
def test_fixations_equal_loop(numbered, trace_rows, block_rows):
    blocks = ordered.with_halo(numbered, 2, block_rows)
    rows = gaze.fixations(blocks, block_rows=block_rows).orderBy("recording_id", "start_ms").collect()
    want = []
    for rec, rs in by_recording(trace_rows).items():
        t0 = rs[0][2] / 1000
        want += [(rec, *f) for f in loop_fixations(
            [r[3] for r in rs], [r[4] for r in rs], [r[2] / 1000 - t0 for r in rs])]
    assert len(rows) == len(want) > 20
    for r, w in zip(rows, sorted(want)):
        assert (r.recording_id, r.n) == (w[0], w[3])
        assert [r.start_ms, r.end_ms, r.mean_x, r.mean_y] == pytest.approx(
            [w[1], w[2], w[4], w[5]], abs=1e-6
        )


def test_null_distance_breaks(spark):
    rows = [(1, i, 60_000 * i, None if i == 2 else 5.0, 5.0, 0.0, None) for i in range(6)]
    points = gaze.with_position(spark.createDataFrame(rows, SCHEMA))
    out = gaze.fixations(ordered.with_halo(points, 2)).orderBy("start_ms").collect()
    # Row 2 breaks; row 3 opens although its distance is unknown.
    assert [(r.fixation_id, r.n) for r in out] == [(1, 2), (4, 3)]


def test_merge_rules(spark):
    rows = [
        (1, 1, 0, 0.2, 0.2, 0.4, 0.4),
        (1, 2, 1, None, None, 0.5, 0.5),
        (1, 3, 2, 0.6, 0.6, None, None),
        (1, 4, 3, None, 0.6, 0.7, 0.7),
        (1, 5, 4, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "recording_id long, sample_id long, device_us long, left_x double, left_y double, right_x double, right_y double"
    )
    plain = [r.gaze_x for r in gaze.merge_eyes(df).orderBy("sample_id").collect()]
    assert plain == [pytest.approx(0.3), 0.5, 0.6, None, None]
    kept = [r.gaze_x for r in gaze.merge_eyes(df, True).orderBy("sample_id").collect()]
    assert kept == [pytest.approx(0.3), 0.5, 0.6, 0.6, None]
    assert gaze.on_screen(gaze.merge_eyes(df)).count() == 3


def test_pixels_round_half_to_even(spark):
    df = spark.createDataFrame([(0.25, 0.75)], "gaze_x double, gaze_y double")
    row = gaze.to_pixels(df, 10, 10).first()
    assert (row.px, row.py) == (2.0, 8.0)


def test_outlier_edges_are_kept(spark):
    xs = [0, 0, 0, 0, 500, 0, 0, 0, 0, 500]
    rows = [(1, i, 4000 * i, float(x), 0.0, 0.0, None) for i, x in enumerate(xs)]
    points = gaze.with_position(spark.createDataFrame(rows, SCHEMA))
    out = gaze.repair_outliers(gaze.blocked(points)).filter("own").orderBy("rn").collect()
    assert [r.px for r in out] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 500]


def test_repeated_timestamp_counts_four_ms(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 0.0, None), (1, 1, 0, 3.0, 4.0, 0.0, None)]
    points = gaze.with_position(spark.createDataFrame(rows, SCHEMA)).drop("velocity", "gap")
    out = gaze.add_motion(gaze.blocked(points)).filter("own").orderBy("rn").collect()
    assert [r.velocity for r in out] == [0.0, pytest.approx(5 / (0.004 * 250))]
    assert [r.isd_ms for r in out] == [0.0, 0.0]


def test_no_task_sees_a_whole_recording(numbered):
    """The largest (key, block) group stays at block size plus halo."""
    blocks = gaze.blocked(numbered, 64)
    top = blocks.groupBy("recording_id", "block").count().agg(F.max("count")).first()[0]
    assert top <= 64 + 2 * gaze.HALO
