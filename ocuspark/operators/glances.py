"""Greedy packing of scan steps into glances, for scans of any length.

A glance takes steps until the next one would exceed the budget; that step opens
the next glance (a single longer step is a glance of its own). What a stretch of
steps does depends on the steps before it only through the time in the glance
that is open at its start, and that time only decides at which step the first
border falls. A stretch is therefore a map: for each place of its first border,
the glances closed after it, the longest of them, and the glance left open. The
map has at most as many places as one glance has steps.

Steps are cut into blocks, each block becomes a map, and FAN neighbouring maps at
a time are composed into one, level by level, each level written. One row a scan
is left. The way back down gives every map, and in the end every block, the
glance open at its start, and each block names the glances that it closes. No
task holds more than a block or FAN maps, however long a scan is.

Times are added one after the other from the start of a glance, also across
blocks, so that exact ties fall as in a plain walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.operators.lineage import cut

FAN = 32  # maps composed at a time
CELLS = 1 << 20  # running sums held at once


class Stretch(NamedTuple):
    """``steps`` up to the first border that an empty glance would meet; the other arrays go by the place of the first border."""

    n: int
    total: float
    steps: np.ndarray
    count: np.ndarray  # glances closed behind the first border
    longest: np.ndarray  # the longest of these
    left: np.ndarray  # time in the glance open at the end
    start: np.ndarray  # step_ord at which that glance starts
    size: np.ndarray  # its steps


class State(NamedTuple):
    """What is known between two steps: the open glance, and the closed ones."""

    current: float = 0.0
    start: int = 0
    size: int = 0
    closed: int = 0
    longest: float = 0.0


STRETCH = pa.schema(
    [("scan_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("total", pa.float64())]
    + [(c, pa.list_(pa.float64())) for c in ("steps",)]
    + [(c, pa.list_(k)) for c, k in (("count", pa.int64()), ("longest", pa.float64()), ("left", pa.float64()), ("start", pa.int64()), ("size", pa.int64()))]
)
STRETCH_DDL = (
    "scan_id bigint, node bigint, n bigint, total double, steps array<double>, count array<bigint>, longest array<double>,"
    " left array<double>, start array<bigint>, size array<bigint>"
)
STATE_DDL = "current double, at bigint, held bigint, closed bigint, most double"
STATE = ["current", "at", "held", "closed", "most"]
GLANCE_DDL = "scan_id bigint, glance bigint, start_ord bigint, n_steps bigint, time_s double"


def first_borders(current: np.ndarray, steps: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """For every open time, the first step that does not fit (len(steps): none) and the glance's time before it.

    A step always fits an empty glance.
    """
    places, times = np.empty(len(current), np.int64), np.empty(len(current))
    rows = max(1, CELLS // (len(steps) + 1))
    for a in range(0, len(current), rows):
        part = current[a : a + rows]
        sums = np.cumsum(np.concatenate([part[:, None], np.broadcast_to(steps, (len(part), len(steps)))], axis=1), axis=1)
        over = sums[:, 1:] > budget
        over[part == 0.0, :1] = False
        place = np.where(over.any(axis=1), over.argmax(axis=1), len(steps)) if len(steps) else np.zeros(len(part), np.int64)
        places[a : a + rows], times[a : a + rows] = place, sums[np.arange(len(part)), place]
    return places, times


def next_borders(steps: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """For a fresh glance at every step: the step at which the next one starts (len(steps): none here), and its time until then."""
    n = len(steps)
    place, time = np.full(n, n, np.int64), np.zeros(n)
    todo, width = np.arange(n), 32
    while len(todo):
        padded = np.append(steps, np.zeros(width))
        rest = []
        for a in range(0, len(todo), max(1, CELLS // width)):
            part = todo[a : a + max(1, CELLS // width)]
            sums = np.cumsum(padded[part[:, None] + np.arange(width)], axis=1)
            over = sums > budget
            over[:, 0] = False
            found = over.any(axis=1)
            k = np.where(found, over.argmax(axis=1), width)
            done = found | (part + width >= n)
            place[part[done]] = np.where(found, part + k, n)[done]
            time[part[done]] = sums[np.arange(len(part)), k - 1][done]
            rest.append(part[~done])
        todo, width = np.concatenate(rest), width * 4
    return place, time


def jumps(place: np.ndarray) -> list[np.ndarray]:
    """Tables of 1, 2, 4, ... borders ahead; the last glance of the block stays where it is."""
    n = len(place)
    out = [np.where(place < n, place, np.arange(n))]
    while (more := out[-1][out[-1]]).tolist() != out[-1].tolist():
        out.append(more)
    return out


def block_stretch(steps: np.ndarray, ords: np.ndarray, budget: float) -> Stretch:
    n = len(steps)
    place, time = next_borders(steps, budget)
    count, longest = (place < n).astype(np.int64), np.where(place < n, time, 0.0)
    for table in (tables := jumps(place)):
        count = count + count[table]
        longest = np.maximum(longest, longest[table])
    last = tables[-1]
    first = min(n, int(place[0]) + 1)
    return Stretch(n, float(np.cumsum(steps)[-1]), *(v[:first] for v in (steps, count, longest, time[last], ords[last], n - last)))


def compose(a: Stretch, b: Stretch, budget: float) -> Stretch:
    """The map of a stretch and the one after it."""
    place, time = first_borders(a.left, b.steps, budget)
    fits = place == len(b.steps)
    at = np.minimum(place, len(b.steps) - 1)
    parts = [
        np.where(fits, a.count, a.count + 1 + b.count[at]),
        np.where(fits, a.longest, np.maximum(np.maximum(a.longest, time), b.longest[at])),
        np.where(fits, time, b.left[at]),
        np.where(fits, a.start, b.start[at]),
        np.where(fits, a.size + b.n, b.size[at]),
    ]
    steps = a.steps
    if a.n == len(a.steps) and first_borders(np.zeros(1), a.steps, budget)[0][0] == a.n:
        # The first border may fall into b.
        steps = np.append(a.steps, b.steps)
        parts = [np.append(x, y) for x, y in zip(parts, (b.count, b.longest, b.left, b.start, b.size))]
        first = min(len(steps), int(first_borders(np.zeros(1), steps, budget)[0][0]) + 1)
        steps, parts = steps[:first], [x[:first] for x in parts]
    return Stretch(a.n + b.n, a.total + b.total, steps, *parts)


def enter(state: State, node: Stretch, budget: float) -> State:
    """The state behind a stretch."""
    j, closed, longest = 0, state.closed, state.longest
    if state.current > 0.0:
        place, time = first_borders(np.array([state.current]), node.steps, budget)
        j = int(place[0])
        if j == len(node.steps):
            return state._replace(current=float(time[0]), size=state.size + node.n)
        closed, longest = closed + 1, max(longest, float(time[0]))
    return State(float(node.left[j]), int(node.start[j]), int(node.size[j]), closed + int(node.count[j]), max(longest, float(node.longest[j])))


def block_glances(state: State, steps: np.ndarray, ords: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start_ord, size and time of the glances that end inside a block, in order."""
    n, j = len(steps), 0
    head: tuple[list[int], list[int], list[float]] = ([], [], [])
    if state.current > 0.0:
        place, time = first_borders(np.array([state.current]), steps, budget)
        j = int(place[0])
        if j == n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        head = ([state.start], [state.size + j], [float(time[0])])
    place, time = next_borders(steps, budget)
    starts = np.array([j])
    for table in reversed(jumps(place)):
        starts = np.unique(np.append(starts, table[starts]))
    starts = starts[place[starts] < n]
    return np.append(head[0], ords[starts]).astype(np.int64), np.append(head[1], place[starts] - starts).astype(np.int64), np.append(head[2], time[starts])


def _read(rows: pa.Table | pa.RecordBatch, i: int) -> Stretch:
    lists = [np.asarray(rows.column(c)[i].values) for c in STRETCH.names[4:]]
    return Stretch(rows.column("n")[i].as_py(), rows.column("total")[i].as_py(), *lists)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), STRETCH)], schema=STRETCH) if rows else STRETCH.empty_table()


def _ordered(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by("node")


class Tree:
    """Written blocks and levels of maps; level 0 has one per block."""

    def __init__(self, steps: DataFrame, budget: float, block_rows: int, fan: int):
        self.budget, self.fan = budget, fan
        real = steps.filter(F.col("step_time_s") > 0).select(
            "scan_id", F.floor((F.col("step_ord") - 1) / block_rows).cast("bigint").alias("node"), "step_ord", F.col("step_time_s").cast("double")
        )
        rows = F.array_sort(F.collect_list(F.struct("step_ord", "step_time_s")))  # at most block_rows
        self.blocks = cut(real.groupBy("scan_id", "node").agg(rows.alias("s")).select("scan_id", "node", F.col("s.step_ord").alias("ords"), F.col("s.step_time_s").alias("times")))
        self.levels = [cut(self.blocks.mapInArrow(self._summaries(), STRETCH_DDL))]
        self.large: list[DataFrame] = []  # scans of more than one map, by level
        while self.levels[-1].agg(F.max("node")).first()[0]:
            large = self.levels[-1].filter("node > 0").select("scan_id").distinct()
            up = self._children(len(self.levels) - 1, large).groupBy("scan_id", "parent").applyInArrow(self._fold(), STRETCH_DDL)
            self.large.append(large)
            self.levels.append(cut(up))

    def _children(self, level: int, large: DataFrame) -> DataFrame:
        return self.levels[level].join(large, "scan_id", "left_semi").withColumn("parent", F.expr(f"node div {self.fan}"))

    def _summaries(self):
        budget = self.budget

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    rows = []
                    for scan, node, ords, times in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column("ords"), part.column("times")):
                        rows.append((scan, node, *block_stretch(np.asarray(times.values), np.asarray(ords.values), budget)))
                    yield from _table(rows).to_batches()

        return run

    def _fold(self):
        budget = self.budget

        def run(table: pa.Table) -> pa.Table:
            table = _ordered(table)
            own = _read(table, 0)
            for i in range(1, table.num_rows):
                own = compose(own, _read(table, i), budget)
            return _table([(table.column("scan_id")[0].as_py(), table.column("parent")[0].as_py(), *own)])

        return run

    def roots(self, level: int) -> DataFrame:
        """Maps of whole scans that stand on this level."""
        nodes = self.levels[level]
        return nodes.join(self.large[level], "scan_id", "left_anti") if level < len(self.large) else nodes

    def ends(self) -> DataFrame:
        """scan_id, total and the state behind the last step of every scan that has steps."""
        budget = self.budget

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                states = [enter(State(), _read(batch, i), budget) for i in range(batch.num_rows)]
                if states:
                    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*states), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("scan_id"), batch.column("total"), *columns], ["scan_id", "total", *STATE])

        out = None
        for level in range(len(self.levels)):
            ends = self.roots(level).mapInArrow(run, f"scan_id bigint, total double, {STATE_DDL}")
            out = ends if out is None else out.unionAll(ends)
        return out

    def entries(self) -> DataFrame:
        """scan_id, node and the state at the start of every block."""
        budget = self.budget
        names = ["scan_id", "node", *STATE]

        def run(table: pa.Table) -> pa.Table:
            table = _ordered(table)
            state = State(*(table.column(c)[0].as_py() for c in STATE))
            states = []
            for i in range(table.num_rows):
                states.append(state)
                state = enter(state, _read(table, i), budget)
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*states), kinds)]
            return pa.table([table.column("scan_id"), table.column("node"), *columns], names=names)

        zero = [F.lit(v).cast(kind).alias(c) for c, v, kind in zip(STATE, State(), ("double", "bigint", "bigint", "bigint", "double"))]
        above = None
        for level in range(len(self.levels) - 1, -1, -1):
            own = self.roots(level).select("scan_id", "node", *zero)
            if above is not None:
                children = self._children(level, self.large[level]).join(above.withColumnRenamed("node", "parent"), ["scan_id", "parent"])
                inner = children.groupBy("scan_id", "parent").applyInArrow(run, f"scan_id bigint, node bigint, {STATE_DDL}")
                own = own.unionAll(inner)
            above = cut(own) if level else own
        return above


def glance_list(tree: Tree, digits: int = 3) -> DataFrame:
    """scan_id, glance (from 1), start_ord, n_steps and time_s of every glance of a tree's scans."""
    budget = tree.budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scan, *known = (batch.column(c)[i].as_py() for c in ("scan_id", *STATE))
                state = State(*known)
                start, size, time = block_glances(state, np.asarray(batch.column("times")[i].values), np.asarray(batch.column("ords")[i].values), budget)
                columns = [pa.array(np.full(len(start), scan)), pa.array(state.closed + 1 + np.arange(len(start))), pa.array(start), pa.array(size), pa.array(time)]
                yield pa.RecordBatch.from_arrays(columns, ["scan_id", "glance", "start_ord", "n_steps", "time_s"])

    inside = tree.blocks.join(tree.entries(), ["scan_id", "node"]).mapInArrow(run, GLANCE_DDL)
    last = tree.ends().select("scan_id", (F.col("closed") + 1).alias("glance"), F.col("at").alias("start_ord"), F.col("held").alias("n_steps"), F.col("current").alias("time_s"))
    return inside.unionAll(last).withColumn("time_s", F.round("time_s", digits))


def glance_summary(steps: DataFrame, tree: Tree, single: float, total: float, digits: int = 3) -> DataFrame:
    """Number, longest and total time of the glances of every scan, and whether the limits hold; zero without steps."""
    ends = tree.ends().select(
        "scan_id", (F.col("closed") + 1).alias("n_glances"), F.greatest("most", "current").alias("longest"), F.col("total").alias("sum_s")
    )
    every = steps.select("scan_id").distinct().join(ends, "scan_id", "left").na.fill(0)
    longest, sum_s = F.col("longest"), F.col("sum_s")
    return every.select(
        "scan_id",
        "n_glances",
        F.round(longest, digits).alias("max_single_glance_s"),
        F.round(sum_s, digits).alias("total_eyes_off_road_s"),
        F.when(F.col("n_glances") > 0, F.round(sum_s / F.col("n_glances"), digits)).otherwise(F.lit(0.0)).alias("mean_glance_s"),
        (longest > single).alias("exceeds_single_glance"),
        (sum_s > total).alias("exceeds_cumulative"),
        ((longest <= single) & (sum_s <= total)).alias("compliant"),
    )
