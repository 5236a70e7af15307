"""Gaze samples -> cleaned signal -> events -> smoothed signal -> fixations.

All steps take and return DataFrames keyed by ``recording_id`` and ordered by
``(device_us, sample_id)``. Unbounded steps run on row blocks (``ordered``), so
one very long recording is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.operators import ordered
from ocuspark.operators.lineage import cut

# Fixed values of the signal definitions (pixels, milliseconds, Hz).
DISPLAY = (883, 682)
FIXATION_DISTANCE = 25.0
FIXATION_MIN_MS = 50.0
OUTLIER_X, OUTLIER_Y = 50.0, 60.0
MAX_VELOCITY = 40.0
SAMPLING_HZ = 250
ZERO_DT_S = 0.004
GAP_BLINK = (99, 200)
SMOOTH_SIGMA_SQ2 = 128.0

KEY = ["recording_id"]
ORDER = ["device_us", "sample_id"]

# Rows of context still valid on either side of a block after each stage.
HALO, HALO_REPAIRED, HALO_MOTION, HALO_EVENTS, HALO_SMOOTH, HALO_STEP = 16, 13, 12, 7, 2, 1


def valid_eye(df: DataFrame) -> DataFrame:
    """Keep samples whose left or right eye is flagged valid."""
    return df.filter((F.col("left_valid") == 1) | (F.col("right_valid") == 1))


def _numbered(df: DataFrame, mins=None) -> DataFrame:
    return ordered.number_rows(df, KEY, ORDER, mins=mins)


def merge_eyes(
    df: DataFrame,
    carry_forward: bool = False,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """One gaze point per sample: mean of both eyes, or the eye that is there.

    A sample with an eye that is only half present has no defined value. It
    becomes null (and leaves at the on-screen filter); with ``carry_forward``
    it repeats the last defined sample, as a sequential reader would.
    """
    lx, ly, rx, ry = (F.col(c) for c in ("left_x", "left_y", "right_x", "right_y"))
    no_left = lx.isNull() & ly.isNull()
    no_right = rx.isNull() & ry.isNull()
    both = lx.isNotNull() & ly.isNotNull() & rx.isNotNull() & ry.isNotNull()

    def pick(left: Column, right: Column) -> Column:
        return F.when(both, (left + right) / 2).when(no_left, right).when(no_right, left)

    merged = df.withColumn("gaze_x", pick(lx, rx)).withColumn("gaze_y", pick(ly, ry))
    if not carry_forward:
        return merged
    defined = both | no_left | no_right
    blocks = ordered.with_halo(cut(_numbered(merged)), 1, block_rows)
    last = F.when(defined, F.struct("rn", "gaze_x", "gaze_y"))
    return (
        ordered.running(blocks, KEY, {"_last": ("max", last)})
        .filter("own")
        .withColumn("gaze_x", F.col("_last.gaze_x"))
        .withColumn("gaze_y", F.col("_last.gaze_y"))
        .drop("_last", "rn", "block", "own", "tail")
    )


def on_screen(df: DataFrame) -> DataFrame:
    """Drop samples outside the display (nulls and NaN go too)."""
    return df.filter(F.col("gaze_x").between(0.0, 1.0) & F.col("gaze_y").between(0.0, 1.0))


def to_pixels(df: DataFrame, width: int = DISPLAY[0], height: int = DISPLAY[1]) -> DataFrame:
    """Normalised -> pixel coordinates, rounded half to even."""
    return df.withColumn("px", F.bround(F.col("gaze_x") * width)).withColumn(
        "py", F.bround(F.col("gaze_y") * height)
    )


def with_position(df: DataFrame) -> DataFrame:
    """Add ``rn`` and ``t_ms``, the time since the first retained sample."""
    numbered = _numbered(df, {"_t0": F.col("device_us")})
    return numbered.withColumn("t_ms", F.col("device_us") / 1000 - F.col("_t0") / 1000).drop("_t0")


def pixel_points(samples: DataFrame) -> DataFrame:
    """Merge, filter, scale and number the samples (no repair yet)."""
    points = to_pixels(on_screen(merge_eyes(samples)))
    points = points.drop("left_x", "left_y", "right_x", "right_y", "gaze_x", "gaze_y")
    return with_position(points)


def _repair(c: str, threshold: float) -> Column:
    """Median repair of a sample that is far from its six neighbours."""
    w = ordered.block_window(KEY)
    near = [F.lag(c, k).over(w) for k in (3, 2, 1)] + [F.lead(c, k).over(w) for k in (1, 2, 3)]
    complete = near[0].isNotNull() & near[-1].isNotNull()
    spread = sum((F.abs(F.col(c) - n) for n in near[1:]), F.abs(F.col(c) - near[0])) / 7
    ranked = F.array_sort(F.array(*near))
    median = (ranked[2] + ranked[3]) / 2
    return F.when(complete & (spread > threshold), median).otherwise(F.col(c))


def blocked(points: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    return ordered.with_halo(points, HALO, block_rows)


def repair_outliers(blocks: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    repaired = (
        blocks.withColumn("_rx", _repair("px", OUTLIER_X))
        .withColumn("_ry", _repair("py", OUTLIER_Y))
        .drop("px", "py")
        .withColumnRenamed("_rx", "px")
        .withColumnRenamed("_ry", "py")
    )
    return ordered.shrink(repaired, HALO_REPAIRED, block_rows)


def add_motion(blocks: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Inter-sample duration, velocity and the gap label of each sample.

    The velocity unit follows the published pipeline: pixels per second divided
    by the sampling rate. Repeated timestamps count as 4 ms.
    """
    w = ordered.block_window(KEY)
    first = F.col("rn") == 1
    dt = (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000
    dt = F.when(dt == 0, F.lit(ZERO_DT_S)).otherwise(dt)
    step = F.sqrt(
        F.pow(F.col("px") - F.lag("px").over(w), 2) + F.pow(F.col("py") - F.lag("py").over(w), 2)
    )
    isd = (F.col("device_us") - F.lag("device_us").over(w)) / 1000
    moving = (
        blocks.withColumn("isd_ms", F.when(first, F.lit(0.0)).otherwise(isd))
        .withColumn("velocity", F.when(first, F.lit(0.0)).otherwise(step / (dt * SAMPLING_HZ)))
        .withColumn("gap", gap_label(F.col("isd_ms")))
    )
    return ordered.shrink(moving, HALO_MOTION, block_rows)


def gap_label(isd: Column) -> Column:
    low, high = GAP_BLINK
    return F.when((isd > low) & (isd < high), F.lit("Blink_End")).when(
        isd > high, F.lit("Noise_End")
    )


def label_events(blocks: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Label saccades, blinks and noise (column ``event``).

    The sequential detector has one bit of state (inside a saccade or not) and
    every sample acts on it in one of four ways: set, clear, flip or keep. The
    state before a sample is therefore the value of the last set/clear sample,
    flipped once for every flip since, which is a running sum and a running max
    per block plus one carried bit. Labels then follow from the state and a
    look-around of three samples.
    """
    w = ordered.block_window(KEY)
    upto = w.rowsBetween(ordered.ALL_BEFORE, 0)
    v = F.col("velocity")
    quiet = lambda k: F.coalesce(F.lead(v, k).over(w) <= MAX_VELOCITY, F.lit(False))
    d = (
        blocks.withColumn("_gap", F.col("gap").isNotNull())
        .withColumn("_fast", v > MAX_VELOCITY)
        .withColumn("_q1", quiet(1))
        .withColumn("_q2", quiet(2))
        .withColumn("_final", F.lead("rn", 1).over(w).isNull())
    )
    opens = ~F.col("_gap") & F.col("_fast") & ~F.col("_q2")
    holds = F.col("_gap") | ~F.col("_q1")
    flip = opens & ~holds
    fixed = ~F.col("_gap") & (opens == holds)
    d = d.withColumn("_flip", flip.cast("bigint")).withColumn(
        "_flips", F.sum(flip.cast("bigint")).over(upto)
    )
    code = F.when(fixed, F.col("rn") * 2 + (opens.cast("bigint") + F.col("_flips")) % 2)
    d = d.withColumn("_code", code).withColumn("_last", F.max("_code").over(upto))

    parts = (
        d.filter("own")
        .withColumn("_part", ordered.half_blocks())
        .groupBy(*KEY, "_part")
        .agg(
            F.sum("_flip").alias("_n"),
            F.max("_code").alias("_lc"),
            F.max("_flips").alias("_end"),
        )
    )
    wp = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(ordered.ALL_BEFORE, 0)
    parts = parts.withColumn("_tot", F.sum("_n").over(wp))
    block_code = F.when(
        F.col("_lc").isNotNull(),
        F.col("_part") * 2 + (F.col("_lc") + F.col("_end") + F.col("_tot")) % 2,
    )
    parts = parts.withColumn("_bc", F.max(block_code).over(wp))
    entry = ((F.coalesce(F.col("_bc"), F.lit(0)) + F.col("_tot")) % 2).alias("_entry")
    carry = ordered.carry_to_next(parts, KEY, [entry])

    d = d.join(carry, [*KEY, "block"], "left")
    base = F.coalesce(F.col("_last"), F.coalesce(F.col("_entry"), F.lit(0)))
    after = ((base + F.col("_flips")) % 2) == 1
    d = d.withColumn("_after", after)
    # Before the first row of a block window the state is the carried one.
    before = F.coalesce(F.lag("_after", 1).over(w), F.coalesce(F.col("_entry"), F.lit(0)) == 1)
    d = d.withColumn("_before", before)

    starts = ~F.col("_before") & F.col("_fast") & ~F.col("_gap")
    closes = F.col("_before") & ~F.col("_gap") & F.col("_q1")
    d = d.withColumn("_starts", starts).withColumn("_closes", closes)
    closed_by_next = F.coalesce(F.lead("_closes", 1).over(w), F.lit(False))
    after_start = F.coalesce(
        F.lag(F.col("_starts") & ~F.col("_q2"), 1).over(w), F.lit(False)
    )
    raw = (
        F.when(closed_by_next, F.lit("Saccade_End"))
        .when(F.col("_gap"), F.col("gap"))
        .when(F.col("_starts") & F.col("_q2"), F.lit("Saccade_End"))
        .when(F.col("_starts") & F.col("_final"), F.lit("Saccade"))
        .when(F.col("_starts"), F.lit("Saccade_Start"))
        .when(F.col("_before") & ~F.col("_closes"), F.lit("Saccade"))
        .when(after_start, F.lit("Saccade"))
        .otherwise(F.lit("Unknown"))
    )
    d = d.withColumn("_raw", raw)
    lonely_end = (
        (F.col("_raw") == "Saccade_End")
        & (F.col("rn") > 1)
        & (F.lag("_raw", 1).over(w) != "Saccade")
    )
    empty_start = (F.col("_raw") == "Saccade_Start") & (
        F.coalesce(F.lead("_raw", 1).over(w), F.lit("")) == "Saccade_End"
    )
    event = F.when(lonely_end | empty_start, F.lit("Noise")).otherwise(F.col("_raw"))
    scratch = [c for c in d.columns if c.startswith("_")]
    return ordered.shrink(d.withColumn("event", event).drop(*scratch), HALO_EVENTS, block_rows)


def smooth(blocks: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Four-tap causal smoothing between saccades (columns ``sx``, ``sy``).

    A saccade start ends a segment; the row before the next saccade end opens a
    new one. The first four rows of a segment stay raw, so only the last start
    or end event and four rows of context matter.
    """
    w = ordered.block_window(KEY)
    marker = F.when(
        F.col("event").isin("Saccade_Start", "Saccade_End"),
        F.col("rn") * 2 + (F.col("event") == "Saccade_End").cast("bigint"),
    )
    d = ordered.running(blocks, KEY, {"_mark": ("max", marker)})
    inside = F.col("_mark").isNull() | (F.col("_mark") % 2 == 1)
    d = d.withColumn("_inside", inside)
    opens = (F.col("rn") == 1) | (
        ~F.col("_inside") & (F.coalesce(F.lead("event", 1).over(w), F.lit("")) == "Saccade_End")
    )
    d = d.withColumn("_opens", opens).withColumn("_member", F.col("_inside") | opens)
    lags = range(1, 5)
    deep = F.col("_member") & ~F.col("_opens")
    for k in lags:
        deep = deep & F.coalesce(F.lag("_member", k).over(w), F.lit(False))
        if k < 4:
            deep = deep & ~F.coalesce(F.lag("_opens", k).over(w), F.lit(True))
    weights = [math.exp(-(k * k) / SMOOTH_SIGMA_SQ2) for k in range(4)]
    total = sum(weights)

    def average(c: str) -> Column:
        taps = [F.lag(c, 3 - k).over(w) if k < 3 else F.col(c) for k in range(4)]
        return sum((t * wt for t, wt in zip(taps[1:], weights[1:])), taps[0] * weights[0]) / total

    d = d.withColumn("_deep", deep)
    out = (
        d.withColumn("sx", F.when(F.col("_deep"), average("px")).otherwise(F.col("px")))
        .withColumn("sy", F.when(F.col("_deep"), average("py")).otherwise(F.col("py")))
        .drop("_mark", "_inside", "_opens", "_member", "_deep")
    )
    return ordered.shrink(out, HALO_SMOOTH, block_rows)


def fixations(
    blocks: DataFrame,
    x: str = "px",
    y: str = "py",
    max_distance: float = FIXATION_DISTANCE,
    min_ms: float = FIXATION_MIN_MS,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """Fixations as gaps-and-islands over blocked rows.

    A sample joins when it is within ``max_distance`` of the one before. A far
    sample closes the fixation and is dropped; the sample after it opens the
    next one untested. In a run of far samples, odd ones are therefore breaks
    and even ones openers, which only needs the position of the last near one.
    Centroids weigh the samples of a fixation 1..n. Fixations that cross block
    borders are put together from per-block sums.
    """
    w = ordered.block_window(KEY)
    dist = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    near = (F.col("rn") == 1) | F.coalesce(dist < max_distance, F.lit(False))
    d = ordered.shrink(blocks.withColumn("_near", near), HALO_STEP, block_rows)
    d = ordered.running(
        d, KEY, {"_anchor": ("max", F.when(F.col("_near"), F.col("rn")))}, strict=True
    )
    opens = (F.col("rn") == 1) | ((F.col("rn") - 1 - F.col("_anchor")) % 2 == 1)
    breaks = (F.col("rn") > 1) & ~F.col("_near") & ((F.col("rn") - F.col("_anchor")) % 2 == 1)
    d = d.filter("own").withColumn(
        "_start",
        F.max(F.when(opens, F.col("rn"))).over(w.rowsBetween(ordered.ALL_BEFORE, 0)),
    )
    i = F.col("rn") - F.col("block") * block_rows
    pieces = (
        d.filter(~breaks)
        .groupBy(*KEY, "block", "_start")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("t_ms").alias("_t0"),
            F.max("t_ms").alias("_t1"),
            F.sum(x).alias("_x"),
            F.sum(y).alias("_y"),
            F.sum(i * F.col(x)).alias("_ix"),
            F.sum(i * F.col(y)).alias("_iy"),
        )
    )
    carry = ordered.prefix_over_blocks(pieces, KEY, "_open", "max", F.col("_start"))
    pieces = pieces.join(carry, [*KEY, "block"], "left").withColumn(
        "fixation_id", F.coalesce("_start", "_open")
    )
    shift = F.col("block") * block_rows - F.col("fixation_id") + 1
    weight = F.col("n") * (F.col("n") + 1) / 2
    return (
        pieces.groupBy(*KEY, "fixation_id")
        .agg(
            F.min("_t0").alias("start_ms"),
            F.max("_t1").alias("end_ms"),
            F.sum("_n").alias("n"),
            F.sum(F.col("_ix") + shift * F.col("_x")).alias("_wx"),
            F.sum(F.col("_iy") + shift * F.col("_y")).alias("_wy"),
        )
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .filter(F.col("duration_ms") >= min_ms)
        .withColumn("mean_x", F.col("_wx") / weight)
        .withColumn("mean_y", F.col("_wy") / weight)
        .drop("_wx", "_wy")
    )


def fixation_summary(points: DataFrame, fix: DataFrame) -> DataFrame:
    """Per recording: fixation count, total and mean duration, fixations per second."""
    span = points.groupBy(*KEY).agg(F.max("t_ms").alias("_span"))
    per = fix.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_ms").alias("total_duration_ms")
    )
    n = F.coalesce(F.col("_n"), F.lit(0))
    return span.join(per, KEY, "left").select(
        *KEY,
        n.alias("n_fixations"),
        F.coalesce("total_duration_ms", F.lit(0.0)).alias("total_duration_ms"),
        (F.col("total_duration_ms") / F.col("_n")).alias("mean_duration_ms"),
        F.when(F.col("_span") > 0, n / (F.col("_span") / 1000)).alias("fixations_per_s"),
    )


def clean_signal(samples: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Samples -> repaired, timed signal with velocity (blocked, halo included)."""
    blocks = blocked(pixel_points(samples), block_rows)
    return add_motion(repair_outliers(blocks, block_rows), block_rows)


def detect_fixations(samples: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """The whole chain: clean, label, smooth, group into fixations."""
    signal = cut(clean_signal(samples, block_rows))
    labelled = cut(label_events(signal, block_rows))
    smoothed = cut(smooth(labelled, block_rows))
    return fixations(smoothed, "sx", "sy", block_rows=block_rows)
