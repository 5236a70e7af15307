"""Quality classifier by compression.

Two zstandard dictionaries are built, from text labelled good and labelled bad.
Every text is compressed in fixed windows against both. The difference of the
sizes is normalised twice, by their sum (which dictionary fits) and by the bytes
read. A logistic curve in these, and in the size under the good dictionary per
byte (text that repeats itself costs little under either), fitted on labelled
documents that the dictionaries have not seen, gives the probability.

The model is fitted on at most ``windows`` labelled windows a class and at most
``calibration`` labelled documents; every document is scored whole.

Defined cases: null and empty texts take the probability of three zeros.
Rows without id, label or text teach nothing. A class without labelled text has
a dictionary of filler, so scores fall back to the base rate. Repeated rows are
scored each; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.llm.text import held_out, written

WINDOW = 1024  # bytes compressed at once
DICTIONARY = 64 << 10
LEVEL = 3
ROWS = 512  # texts scored at once
COLUMNS = ("by_sum", "by_bytes", "cost")


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # one a column of COLUMNS, then the offset

    def probability(self, raw: np.ndarray) -> np.ndarray:
        line = raw @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(line, -30.0, 30.0)))


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """Trained dictionary; plain content where there is too little text to train on."""
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(windows) or b" " * 64)[:size]


class _Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self._run = []
        for content in (good, bad):
            book = zstandard.ZstdCompressionDict(content)
            book.precompute_compress(level=level)
            params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._run.append(zstandard.ZstdCompressor(dict_data=book, compression_params=params).compress)

    def raw(self, text: bytes) -> tuple[float, float, float]:
        good, bad = self._run
        g = b = 0
        for i in range(0, len(text), WINDOW):
            window = text[i : i + WINDOW]
            g += len(good(window))
            b += len(bad(window))
        return ((b - g) / (b + g), (b - g) / len(text), g / len(text)) if text else (0.0, 0.0, 0.0)

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.array([self.raw(t.as_py() or b"") for t in column.cast(pa.large_binary())]).reshape(-1, len(COLUMNS))


def _raw_scores(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """The rows with column text replaced by the columns of COLUMNS."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(good, bad)
        for batch in batches:
            raw = sizes.matrix(batch.column("text"))
            columns = [*(batch.column(c) for c in names), *(pa.array(x) for x in raw.T)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *COLUMNS])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"{c} double" for c in COLUMNS)]))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights and offset of a logistic curve by damped Newton steps on standardised columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        line = z @ w
        return float(np.logaddexp(0, line).sum() - y @ line + ridge * (w @ w) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step, rate = np.linalg.solve(h, g), 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


def fit_quality(docs: DataFrame, labels: DataFrame, windows: int = 4000, calibration: int = 20000) -> QualityModel:
    """Dictionaries from three quarters of the learnable documents, calibration on the rest.

    Both samples are chosen by a hash of the id, so reruns agree.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    # The ids are chosen from the labels alone: at most 2 x windows + calibration of them meet the texts.
    shuffled = lambda part, n: part.orderBy(F.xxhash64("doc_id", F.lit(2))).limit(n)
    chosen = shuffled(marks.filter("turn = 0"), calibration)
    for mark in (0, 1):
        chosen = chosen.unionAll(shuffled(marks.filter((F.col("turn") > 0) & (F.col("quality") == mark)), windows))
    chosen = F.broadcast(written(chosen, "quality-chosen"))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = slim.filter(F.col("text").isNotNull()).join(chosen, "doc_id")
    # One window a document, at a place its id decides, so that long texts do not fill the sample.
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / WINDOW)).cast("int")
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), pieces).cast("int")
    teach = known.filter(F.col("turn") > 0).select(
        "quality", F.substring(F.col("text"), place * WINDOW + 1, F.lit(WINDOW)).alias("window"), F.xxhash64("doc_id", F.lit(2)).alias("order")
    )
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for mark in (0, 1):
        chosen = teach.filter(F.col("quality") == mark).orderBy("order", "window").limit(windows)
        parts[mark] = [r[0].encode() for r in chosen.select("window").collect()]
    good, bad = _dictionary(parts[1], DICTIONARY), _dictionary(parts[0], DICTIONARY)
    check = known.filter(F.col("turn") == 0).select("text", "quality", "doc_id")
    scored = _raw_scores(check, good, bad).orderBy(F.xxhash64("doc_id", F.lit(3)), *COLUMNS).limit(calibration)
    rows = np.array([tuple(r) for r in scored.select(*COLUMNS, "quality").collect()], dtype=np.float64).reshape(-1, len(COLUMNS) + 1)
    if len(rows):
        return QualityModel(good, bad, logistic_fit(rows[:, :-1], rows[:, -1]))
    base = math.log((len(parts[1]) + 1) / (len(parts[0]) + 1))
    return QualityModel(good, bad, (*[0.0] * len(COLUMNS), base))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = _raw_scores(slim, model.good, model.bad)
    line = F.lit(model.weights[-1])
    for name, weight in zip(COLUMNS, model.weights):
        line = line + F.lit(weight) * F.col(name)
    line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))
    return raw.select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold. Only texts leave the JVM, once."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = _Sizes(model.good, model.bad)
        for part in parts:
            good = [model.probability(sizes.matrix(part.slice(a, ROWS))) >= threshold for a in range(0, len(part), ROWS)]
            yield pa.array(np.concatenate(good) if good else [], pa.bool_())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))
