"""Gaze streams: cleaning, live fixations, live event labels, windows, dedup.

Streams carry ``event_time`` (timestamp) besides the gaze columns. Everything
but the two detectors is declarative; the detectors keep a few numbers per
recording in the state store (RocksDB), besides the rows that wait for the
watermark, so files may arrive in any order within the delay. A recording is one
device at a fixed sampling rate, so the rows of a key per micro-batch are bounded
by the trigger interval.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from ocuspark.operators import gaze
from ocuspark.operators.lineage import cut, ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A longer pause between two samples of a recording ends what is open. The rule looks
#: at the samples, so results do not depend on how files are batched; the timer of the
#: same length only finishes a recording that sends nothing more.
QUIET_MS = 1_000
#: Where the device clock's zero lies on the stream's clock, a day after that one's own. A stream
#: begins with a watermark of zero and drops what is not after it: a first sample at device time 0.
ZERO_MS = 86_400_000


def with_event_time(samples: DataFrame, delay: str = "2 seconds") -> DataFrame:
    shifted = F.timestamp_micros(F.col("device_us") + ZERO_MS * 1000)
    return samples.withColumn("event_time", shifted).withWatermark("event_time", delay)


def device_time(time: Column) -> Column:
    """A time of the stream's clock on the device's."""
    return F.timestamp_micros(F.unix_micros(time) - ZERO_MS * 1000)


def clean(samples: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Stateless part of the cleaning: merge eyes, keep on-screen, pixels."""
    rows = gaze.valid_eye(samples) if drop_invalid else samples
    points = gaze.to_pixels(gaze.on_screen(gaze.merge_eyes(rows)))
    return points.drop("left_x", "left_y", "right_x", "right_y", "gaze_x", "gaze_y")


def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


class InOrder(StatefulProcessor):
    """Gives the rows of a recording to a detector in event order, whatever order they arrive in.

    Rows wait in a buffer until the watermark has passed them: then no earlier row
    can come, as the engine drops rows behind the watermark. A timer on the
    earliest waiting row starts the release, and one QUIET_MS after the last
    released row finishes a recording that went quiet. The buffer holds what
    arrives within the watermark's delay and one trigger.

    A detector says ``held`` (columns behind sample_id and device_us), ``kept``
    (its state) and ``absorb``, ``finish`` and ``blank``.
    """

    held: StructType
    kept: StructType
    out: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([*_struct(sample_id=LongType, device_us=LongType), *self.held]))
        self.state = handle.getValueState("open", self.kept)
        self.last = handle.getValueState("last", _struct(us=LongType))

    def blank(self) -> tuple:
        raise NotImplementedError

    def absorb(self, key, state: tuple, rows: list[tuple], since: int | None) -> tuple[list[tuple], tuple]:
        """Finished rows and the new state; ``since`` is the time of the row before."""
        raise NotImplementedError

    def finish(self, key, state: tuple, last: int) -> list[tuple]:
        """Rows that end when nothing follows ``last``."""
        raise NotImplementedError

    def _wake(self, us: list[int], last: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [min(us)] if us else []
        if last is not None:
            times.append(last + QUIET_MS * 1000)
        for t in {-(-t // 1000) for t in times}:
            self.handle.registerTimer(t + ZERO_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        names = ["sample_id", "device_us", *self.held.names]
        low: list[int] = []
        for batch in rows:
            columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in names]
            self.waiting.appendList(list(zip(*columns)))
            low.append(int(batch["device_us"].min()))
        for timer in self.handle.listTimers():
            low.append((timer - ZERO_MS) * 1000)
        self._wake(low, None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = (timerValues.getCurrentWatermarkInMs() - ZERO_MS) * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        cut = next((i for i, r in enumerate(rows) if r[1] > mark), len(rows))
        done: list[tuple] = []
        state = tuple(self.state.get()) if self.state.exists() else self.blank()
        last = self.last.get()[0] if self.last.exists() else None
        if cut:
            done, state = self.absorb(key, state, rows[:cut], last)
            last = rows[cut - 1][1]
            if rows[cut:]:
                self.waiting.put(rows[cut:])
            else:
                self.waiting.clear()
        if last is not None and last + QUIET_MS * 1000 <= mark:
            done += self.finish(key, state, last)
            self.state.clear()
            self.last.clear()
            last = None
        elif last is not None:
            self.state.update(state)
            self.last.update((last,))
        self._wake([r[1] for r in rows[cut:]], last)
        if done:
            yield pd.DataFrame(done, columns=self.out.names)

    def close(self) -> None:
        pass


class FixationProcessor(InOrder):
    """State: size, start, last point and weighted sums of the open fixation.

    Size 0 stands for "the last sample broke a fixation": the next one opens. A
    fixation is closed by the sample that breaks it, or QUIET_MS after its last.
    """

    held = _struct(px=DoubleType, py=DoubleType)
    kept = _struct(n=LongType, start_us=LongType, x=DoubleType, y=DoubleType, wx=DoubleType, wy=DoubleType)
    out = StructType(
        [
            *_struct(recording_id=LongType, start_us=LongType, end_us=LongType, n=LongType, mean_x=DoubleType, mean_y=DoubleType),
            StructField("closed_at", TimestampType()),
        ]
    )

    def blank(self) -> tuple:
        return 0, 0, 0.0, 0.0, 0.0, 0.0

    def _close(self, key, s: tuple, last: int, closed: int) -> list[tuple]:
        n, start, _, _, wx, wy = s
        if n == 0 or (last - start) / 1000 < gaze.FIXATION_MIN_MS:
            return []
        weight = n * (n + 1) / 2
        return [(key[0], start, last, n, wx / weight, wy / weight, pd.Timestamp(closed + ZERO_MS * 1000, unit="us"))]

    def absorb(self, key, state, rows, since):
        n, start, lx, ly, wx, wy = state
        done: list[tuple] = []
        for _, us, x, y in rows:
            if n > 0 and us - since > QUIET_MS * 1000:
                done += self._close(key, (n, start, lx, ly, wx, wy), since, since + QUIET_MS * 1000)
                n = 0
            if n == 0:
                n, start, wx, wy = 1, us, x, y
            elif ((x - lx) ** 2 + (y - ly) ** 2) ** 0.5 < gaze.FIXATION_DISTANCE:
                n += 1
                wx, wy = wx + n * x, wy + n * y
            else:
                done += self._close(key, (n, start, lx, ly, wx, wy), since, us)
                n = 0
            since, lx, ly = us, x, y
        return done, (n, start, lx, ly, wx, wy)

    def finish(self, key, state, last):
        return self._close(key, state, last, last + QUIET_MS * 1000)


AHEAD, BEHIND = 3, 2


def label_run(velocity, gap, busy: bool, at_start: bool, at_end: bool):
    """Labels of consecutive samples, and the saccade state before each.

    ``busy`` is the state before the first sample. The last three labels are
    only final when ``at_end``; the first two only when ``at_start``.
    """
    n, limit = len(velocity), gaze.MAX_VELOCITY
    fast = [v > limit for v in velocity]
    quiet = lambda i: i < n and not fast[i]
    raw = ["Unknown"] * n
    states = []
    for i in range(n):
        states.append(busy)
        if gap[i]:
            raw[i] = gap[i]
            continue
        if not busy and fast[i]:
            final = at_end and i == n - 1
            raw[i] = "Saccade" if final else "Saccade_Start"
            if quiet(i + 2):
                raw[i] = "Saccade_End"
            else:
                busy = True
                if i + 1 < n:
                    raw[i + 1] = "Saccade"
        elif busy and quiet(i + 1):
            if i > 0:
                raw[i - 1] = "Saccade_End"
            busy = False
        elif busy:
            raw[i] = "Saccade"
    out = list(raw)
    for i in range(n):
        if raw[i] == "Saccade_End" and not (i == 0 and at_start):
            if i > 0 and raw[i - 1] != "Saccade":
                out[i] = "Noise"
        if raw[i] == "Saccade_Start" and i + 1 < n and raw[i + 1] == "Saccade_End":
            out[i] = "Noise"
    return out, states


class EventProcessor(InOrder):
    """State: saccade flag, number of labelled samples and a five-sample buffer."""

    held = _struct(velocity=DoubleType, gap=StringType)
    kept = StructType(
        [
            StructField("busy", BooleanType()),
            StructField("done", LongType()),
            StructField("ids", ArrayType(LongType())),
            StructField("us", ArrayType(LongType())),
            StructField("velocity", ArrayType(DoubleType())),
            StructField("gap", ArrayType(StringType())),
        ]
    )
    out = _struct(recording_id=LongType, sample_id=LongType, device_us=LongType, event=StringType)

    def blank(self) -> tuple:
        return False, 0, [], [], [], []

    def _label(self, key, busy, done, ids, us, velocity, gap, at_end: bool):
        seen = min(done, BEHIND)
        labels, states = label_run(velocity, gap, busy, done <= BEHIND, at_end)
        last = len(ids) if at_end else max(seen, len(ids) - AHEAD)
        rows = [(key[0], ids[i], us[i], labels[i]) for i in range(seen, last)]
        keep = max(0, last - BEHIND)
        done += last - seen
        rest = (
            states[keep] if keep < len(states) else busy,
            done,
            ids[keep:],
            us[keep:],
            velocity[keep:],
            gap[keep:],
        )
        return rows, rest

    def absorb(self, key, state, rows, since):
        busy, done, *kept = state
        ids, us, velocity, gap = ([*old, *new] for old, new in zip(kept, zip(*rows)))
        gap = [g or "" for g in gap]
        out: list[tuple] = []
        begin = 0
        for i in range(1, len(us)):
            if us[i] - us[i - 1] > QUIET_MS * 1000:
                part = slice(begin, i)
                out += self._label(key, busy, done, ids[part], us[part], velocity[part], gap[part], True)[0]
                busy, done, begin = False, 0, i
        more, rest = self._label(key, busy, done, ids[begin:], us[begin:], velocity[begin:], gap[begin:], False)
        return out + more, rest

    def finish(self, key, state, last):
        return self._label(key, *state, True)[0]


def _stateful(df: DataFrame, processor: InOrder, event_time: str = "") -> DataFrame:
    df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return df.groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=processor.out,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName=event_time,
    )


def live_fixations(points: DataFrame) -> DataFrame:
    """Finished fixations of a cleaned point stream (px, py).

    ``closed_at``, when a fixation was known to be over, is the stream's event
    time (on its clock, see ZERO_MS), so windows and joins may follow in the same query.
    """
    columns = ["recording_id", "sample_id", "device_us", "px", "py", "event_time"]
    return _stateful(points.select(*columns), FixationProcessor(), "closed_at")


def live_events(signal: DataFrame) -> DataFrame:
    """Event labels of a stream with ``velocity`` and ``gap`` columns."""
    columns = ["recording_id", "sample_id", "device_us", "velocity", "gap", "event_time"]
    return _stateful(signal.select(*columns), EventProcessor())


def recording_sessions(samples: DataFrame, gap: str = "200 milliseconds") -> DataFrame:
    """Stretches of a recording without a pause longer than ``gap``."""
    return (
        samples.groupBy("recording_id", F.session_window("event_time", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .select(
            "recording_id",
            device_time(F.col("session.start")).alias("session_start"),
            device_time(F.col("session.end")).alias("session_end"),
            "n_samples",
        )
    )


def aoi_tiles(elements: DataFrame, size: int = 32) -> DataFrame:
    """Static side of the stream join: (screen_id, tile_x, tile_y), whether one element covers the tile, and the others clipped to it.

    A covered tile keeps no boxes and equal pieces count once, so a row is bounded
    by the tile's size, not by the number of elements.
    """
    x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")

    def tiles(low, high):
        return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))

    cut = (
        elements.select("screen_id", x.alias("x"), y.alias("y"), x1.alias("x1"), y1.alias("y1"))
        .withColumn("tile_x", tiles(F.col("x"), F.col("x1")))
        .withColumn("tile_y", tiles(F.col("y"), F.col("y1")))
    )
    left, top = F.col("tile_x") * size, F.col("tile_y") * size
    box = F.struct(
        F.greatest("x", left).alias("x"), F.greatest("y", top).alias("y"), F.least("x1", left + size).alias("x1"), F.least("y1", top + size).alias("y1")
    )
    whole = (box["x"] == left) & (box["y"] == top) & (box["x1"] == left + size) & (box["y1"] == top + size)
    merged = cut.groupBy("screen_id", "tile_x", "tile_y").agg(F.max(whole).alias("covered"), F.collect_set(F.when(~whole, box)).alias("boxes"))
    return merged.withColumn("boxes", F.when(~F.col("covered"), F.col("boxes")))


def aoi_hits(fixations: DataFrame, shown: DataFrame, elements: DataFrame, size: int = 32) -> DataFrame:
    """A fixation stream with ``hit``: does an element of the shown screen contain its mean point (borders included)?

    ``shown`` (recording_id, screen_id) and ``elements`` are static. The join is
    by screen and tile and meets at most one row, so it neither drops nor repeats
    a fixation and needs no state; the watermark passes through. A fixation of a
    recording without screen is no hit. The tiles of the screens that are shown are
    made once and written, as every micro-batch reads them.
    """
    seen = elements.join(shown.select("screen_id").distinct(), "screen_id", "left_semi")
    tiles = cut(aoi_tiles(seen, size))
    x, y = F.col("mean_x"), F.col("mean_y")
    placed = fixations.join(shown, "recording_id", "left").withColumns({"tile_x": F.floor(x / size), "tile_y": F.floor(y / size)})
    inside = F.exists("boxes", lambda b: x.between(b["x"], b["x1"]) & y.between(b["y"], b["y1"]))
    hit = F.coalesce(F.col("covered"), F.lit(False)) | F.coalesce(inside, F.lit(False))
    return placed.join(tiles, ["screen_id", "tile_x", "tile_y"], "left").select(*fixations.columns, "screen_id", hit.alias("hit"))


def hit_rates(hits: DataFrame, length: str = "10 minutes", slide: str | None = None, time: str = "event_time") -> DataFrame:
    """AOI hit rate and fixation count per (sliding) window of the column ``time``.

    Windows have no other key, so counts combine before the shuffle. Those over
    the detector's ``closed_at`` are given in device time; their slide divides a day.
    """
    given = device_time if time == "closed_at" else (lambda c: c)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        hits.groupBy(w.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_fixations"),
            F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        )
        .select(
            given(F.col("w.start")).alias("window_start"),
            given(F.col("w.end")).alias("window_end"),
            "n_fixations",
            "hit_rate",
        )
    )


def unique_uploads(uploads: DataFrame) -> DataFrame:
    """Each content hash once within the watermark delay."""
    return uploads.dropDuplicatesWithinWatermark(["sha256"])


def run_available(stream: DataFrame) -> DataFrame:
    """Process everything available into a table and return that table."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
