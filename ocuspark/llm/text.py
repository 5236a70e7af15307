"""Words, batches and written stages shared by the text operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; on UTF-8 bytes
that is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocuspark.operators.lineage import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def written(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Write a stage to the shared checkpoint folder and read it back.

    The files outlive executors; what follows never recomputes the stage. The
    folder is added to ``scratch``, for ``removed``.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if scratch is not None:
        scratch.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the folders of written stages that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in scratch:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    scratch.clear()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows: bounds what a worker and its task hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row: bounds the temporary arrays."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the number of its first word (len + 1)."""
    n = len(body)
    inside = ~_SPACE[body]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = inside[edges]
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside
    end[1:n] &= ~inside[1:]
    end[edges] |= inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=U64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS[base]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of every byte span, from prefix sums of a polynomial with an odd base."""
    up, down = _powers(base, len(body) + 1)
    sums = np.zeros(len(body) + 1, dtype=U64)
    np.cumsum((body.astype(U64) + U64(1)) * up[: len(body)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
