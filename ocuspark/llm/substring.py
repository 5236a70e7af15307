"""Substring deduplication by seeds and extension.

Every window of n words has an anchor: the smallest hash among its runs of
``seed`` words (winnowing), so equal windows have equal anchors. Documents meet on
anchors. A stretch of neighbouring windows with one anchor is extended to both
sides as far as that anchor decides, and the words of that extension are hashed:

* all extensions of an anchor agree: its windows are repeats in every document
  but the first, and are settled without being looked at one by one;
* they differ (a repeat begins or ends there): each window around the anchor is
  compared by a 128-bit hash with those of all other documents.

No pair of documents is formed, so a passage that a third of all documents hold
costs its rows once. Windows that touch or overlap are joined to maximal repeats,
whose words go. The result is exact up to hashes of 96 and 128 bits.

Anchors meet in one exchange: those that a sample of documents shows to be
frequent are spread over several tasks and take their totals from a small table
made of all rows; the sample changes the spreading, never the result. Exact
copies of a text lose all words at once. Texts travel compressed.

Defined cases: null and empty texts have no words; a text of fewer than n words
loses none. Rows that share a doc_id are told apart by text and never remove
each other's words. A row without doc_id neither removes nor loses words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.llm.text import U64, _powers, mix, slices, span_hashes, utf8, word_spans, written

WINDOW = 13
SEED = 5
SLICE = 1 << 18  # bytes of text whose words are hashed at a time
SAMPLE = 16  # one document in so many shows which anchors are frequent
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEPS = (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F)


def _runs(hashes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbours."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=U64)
    for i in range(width):
        out = (out + hashes[i : len(hashes) - width + 1 + i]) * U64(step)
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Block:
    """Windows of a block of texts: ``rows[i]`` and ``places[i]`` of window i, and its anchor."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, n: int, seed: int):
        self.body, self.n = body, n
        self.starts, self.ends, self.first = word_spans(body, offsets)
        self.counts = np.diff(self.first)
        per_row = np.maximum(self.counts - n + 1, 0)
        self.rows = np.repeat(np.arange(len(per_row)), per_row)
        at = np.arange(len(self.rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        self.places = at
        self.windows = self.first[:-1][self.rows] + at
        if len(self.windows):
            words = span_hashes(body, self.starts, self.ends, _BASES[0])
            self.words = words
            self.anchors = _least(_runs(words, seed, _STEPS[0]), n - seed + 1)[self.windows]
        else:
            self.anchors = np.zeros(0, dtype=U64)

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        other = span_hashes(self.body, self.starts, self.ends, _BASES[1])
        return _runs(self.words, self.n, _STEPS[0])[self.windows], _runs(other, self.n, _STEPS[1])[self.windows]

    def extensions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor and hash of the words of every stretch of windows with one anchor."""
        new = np.ones(len(self.anchors), dtype=bool)
        new[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.rows[1:] != self.rows[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        start, end = self.windows[first], self.windows[last] + self.n
        up, down = _powers(_BASES[1], len(self.words) + 1)
        sums = np.zeros(len(self.words) + 1, dtype=U64)
        np.cumsum(self.words * up[: len(self.words)], out=sums[1:])
        words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
        return self.rows[first], _short(self.anchors[first]), _short(words)


def _blocks(column: pa.Array, n: int, seed: int) -> Iterator[tuple[int, int, _Block]]:
    body, offsets = utf8(column)
    for a, b in slices(offsets, SLICE):
        yield a, b, _Block(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, seed)


def _short(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a hash: what the exchange of anchors carries."""
    return (hashes & U64((1 << 48) - 1)).astype(np.int64)


def anchors(docs: DataFrame, n: int = WINDOW, seed: int = SEED) -> DataFrame:
    """anchor, doc_id and around (hash of the extension) of every stretch of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for a, _, block in _blocks(batch.column("text"), n, seed):
                if len(block.anchors):
                    rows, anchor, around = block.extensions()
                    columns = [pa.array(anchor), pa.array(ids[a + rows]), pa.array(around)]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "around"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor bigint, doc_id bigint, around bigint")


def _met(seeds: DataFrame, named: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, anchor, open for the anchors of a document that matter: shared ones, without those it holds first."""
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = anchors(named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), n, seed)
    often = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    total = often.agg(F.sum("n")).scalar()
    # Over an eighth of a fair share, so at most 8 x parts anchors, however large the data.
    often = often.filter((F.col("n") * 8 * parts > total) & (F.col("n") > 2)).select("anchor", F.lit(True).alias("often"))
    often = F.broadcast(written(often, "substring-frequent"))
    totals = seeds.join(often, "anchor").groupBy("anchor").agg(
        F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.min("around").alias("_least"), F.max("around").alias("_most")
    )
    totals = F.broadcast(written(totals, "substring-totals"))
    spread = seeds.join(often, "anchor", "left").withColumn("piece", F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(8 * parts))).otherwise(0))
    group = Window.partitionBy("anchor", "piece")
    stats = spread.select(
        "anchor", "doc_id", "often",
        F.min("doc_id").over(group).alias("lo"), F.max("doc_id").over(group).alias("hi"),
        F.min("around").over(group).alias("least"), F.max("around").over(group).alias("most"),
    ).filter("often OR lo < hi")
    stats = stats.join(totals, "anchor", "left").select(
        "anchor", "doc_id",
        *[F.when(F.col("often"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi", "least", "most")],
    )
    open_ = F.col("least") < F.col("most")
    return stats.filter((F.col("lo") < F.col("hi")) & (open_ | (F.col("doc_id") > F.col("lo")))).select("doc_id", "anchor", open_.alias("open"))


def _packed(rows: DataFrame) -> DataFrame:
    """Replaces text by its bytes, compressed."""
    names = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.as_py()) for t in batch.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), packed], [*names, "packed"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "packed binary"]))


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _marked(block: _Block, lists: pa.Array, copies: np.ndarray) -> np.ndarray:
    """Windows whose anchor is in their row's list; rows of copies have none."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    if not sizes.any() or not len(block.anchors):
        return np.zeros(len(block.anchors), dtype=bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    listed = np.asarray(lists.flatten()).view(U64)[~copies[row]]
    marks = np.unique(mix(listed ^ mix(row[~copies[row]].astype(U64))))
    return np.isin(mix(_short(block.anchors).view(U64) ^ mix(block.rows.astype(U64))), marks)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "n_removed bigint, repeats array<struct<start:bigint,end:bigint>>, kept string, kept_sha256 string"


def _result(text: bytes, cover: np.ndarray | None, digest: bool) -> tuple:
    """Words removed, spans, words kept (None: all), and if asked for their digest."""
    if cover is None or not cover.any():
        return 0, [], None, hashlib.sha256(b" ".join(text.split())).hexdigest() if digest else None
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
    own = text.split()
    kept = b" ".join([own[i] for i in np.flatnonzero(~cover)])
    spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
    return int(cover.sum()), spans, kept.decode("utf-8"), hashlib.sha256(kept).hexdigest() if digest else None


def _columns(results: list[tuple], keep: bool) -> list[pa.Array]:
    removed, spans, kept, digests = zip(*results) if results else ((), (), (), ())
    kept = kept if keep else [None] * len(kept)
    return [pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string()), pa.array(digests, pa.string())]


def _candidates(met: DataFrame, n: int, seed: int, keep: bool, digest: bool) -> DataFrame:
    """Settles the rows without open windows; the others get their places, hashes and the places already gone.

    packed stays where it is needed: for open rows, and for all if ``keep``.
    """
    kinds = dict(met.dtypes)
    names = ["row", "doc_id", "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                yield from part(batch.slice(i, 128), unpack)

    def part(batch: pa.RecordBatch, unpack) -> Iterator[pa.RecordBatch]:
        texts = [unpack(t) for t in batch.column("packed").to_pylist()]
        copies = np.asarray(batch.column("copy").fill_null(False))
        for a, b, block in _blocks(pa.array(texts, pa.large_binary()), n, seed):
            gone = _marked(block, batch.column("gone").slice(a, b - a), copies[a:b])
            open_ = _marked(block, batch.column("open").slice(a, b - a), copies[a:b])
            one = two = np.zeros(0, dtype=np.int64)
            if open_.any():
                one, two = (h[open_].view(np.int64) for h in block.window_hashes())
            open_counts = np.bincount(block.rows[open_], minlength=b - a)
            gone_counts = np.bincount(block.rows[gone], minlength=b - a)
            gone_at = np.cumsum(gone_counts) - gone_counts
            gone_places = block.places[gone]
            results, packed = [], []
            for j in range(b - a):
                words = int(block.counts[j])
                if open_counts[j]:
                    results.append((None, None, None, None))
                elif copies[a + j] and words >= n:
                    results.append(_result(texts[a + j], np.ones(words, dtype=bool), digest))
                else:
                    places = gone_places[gone_at[j] : gone_at[j] + gone_counts[j]]
                    results.append(_result(texts[a + j], covered(words, places, n) if len(places) else None, digest))
                packed.append(batch.column("packed")[a + j].as_py() if keep or open_counts[j] else None)
            more = [
                pa.array(packed, pa.binary()),
                pa.array(block.counts.astype(np.int64)),
                _lists(gone_counts, gone_places.astype(np.int32), pa.int32()),
                _lists(open_counts, block.places[open_].astype(np.int32), pa.int32()),
                _lists(open_counts, one, pa.int64()),
                _lists(open_counts, two, pa.int64()),
                *_columns(results, keep),
            ]
            own = [batch.column(c).slice(a, b - a) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, *more], [*names, "packed", "n_words", "gone", "places", "one", "two", "n_removed", "repeats", "kept", "kept_sha256"]
            )

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return met.mapInArrow(
        run, f"{fields}, packed binary, n_words bigint, gone array<int>, places array<int>, one array<bigint>, two array<bigint>, {_RESULT}"
    )


def covered(n_words: int, places: list[int] | np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places: the maximal repeats."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    places = np.unique(np.asarray(places, dtype=np.int64))
    edge[places] += 1
    np.subtract.at(edge, places + n, 1)
    return np.cumsum(edge[:-1]) > 0


def _settled(rows: DataFrame, n: int, keep: bool, digest: bool, whole: bool) -> DataFrame:
    """Result of rows with open windows, by the places gone before (gone) and found since (later).

    With ``whole`` the text takes the place of packed, so that no second Python worker has to unpack it.
    """
    names = ["row", "doc_id", "n_words"]
    kinds = dict(rows.dtypes)
    body = "text" if whole else "packed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                yield part(batch.slice(i, 128))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        results, texts = [], []
        for packed, words, gone, later in zip(batch.column("packed"), batch.column("n_words").to_pylist(), batch.column("gone"), batch.column("later")):
            places = np.concatenate([np.asarray(x.values) for x in (gone, later) if x.is_valid and len(x)] or [np.zeros(0, np.int32)])
            text = unpack(packed.as_py())
            results.append(_result(text, covered(words, places, n) if len(places) else None, digest))
            texts.append(text.decode("utf-8") if whole else None)
        bodies = pa.array(texts, pa.string()) if whole else batch.column("packed")
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), bodies, *_columns(results, keep)], [*names, body, "n_removed", "repeats", "kept", "kept_sha256"]
        )

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(run, f"{fields}, {body} {'string' if whole else 'binary'}, {_RESULT}")


def remove_repeats(docs: DataFrame, n: int = WINDOW, seed: int = SEED, keep: bool = True, digest: bool = False) -> DataFrame:
    """row (all columns of docs but text, as a struct), doc_id, packed, n_words, n_removed, repeats (spans of words), kept, kept_sha256.

    kept holds the words left, joined by one space, and is null where nothing was
    removed; packed is the compressed text. Without ``keep`` both stay null. With
    ``digest`` kept_sha256 is the digest of the words left.
    """
    late, early = _late_and_early(docs, n, seed, keep, digest, whole=False)
    return late.unionAll(early.select(late.columns))


def _late_and_early(docs: DataFrame, n: int, seed: int, keep: bool, digest: bool, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with open windows, settled last (with ``whole``: text in place of packed), and the others."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    named = rows.filter("doc_id IS NOT NULL").select("doc_id", "text")
    same = named.select("doc_id", F.md5("text").alias("key"))
    first = same.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    first = written(first, "substring-copies")
    copies = same.join(first, "key").filter("doc_id > lo").select("doc_id", F.xxhash64("key").alias("text_key")).distinct()

    hits = _met(anchors(named, n, seed), named, n, seed).withColumn("copied", F.lit(None).cast("bigint"))
    hits = hits.unionByName(copies.select("doc_id", F.col("text_key").alias("copied")), allowMissingColumns=True)
    # One list a document, so that the texts are dealt once.
    hits = hits.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("open"), F.col("anchor"))).alias("open"),
        F.collect_set(F.when(~F.col("open"), F.col("anchor"))).alias("gone"),
        F.collect_set("copied").alias("copied"),
    )
    keyed = _packed(rows.withColumn("text_key", F.xxhash64(F.md5("text"))))
    met = keyed.join(hits, "doc_id", "left").withColumn("copy", F.array_contains("copied", F.col("text_key")))
    found = written(_candidates(met.select("row", "doc_id", "text_key", "packed", "copy", "open", "gone"), n, seed, keep, digest), "substring-candidates")

    windows = found.filter(F.size("places") > 0).select("doc_id", "text_key", F.inline(F.arrays_zip("places", "one", "two")))
    repeated = windows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    repeated = written(repeated.select("one", "two", "lo"), "substring-repeats")
    later = windows.join(repeated, ["one", "two"]).filter("doc_id > lo")
    later = later.groupBy("doc_id", "text_key").agg(F.collect_set("places").alias("later"))

    open_rows = found.filter(F.size("places") > 0).select("row", "doc_id", "text_key", "packed", "n_words", "gone")
    late = _settled(open_rows.join(later, ["doc_id", "text_key"], "left"), n, keep, digest, whole)
    early = found.filter(F.size("places") == 0)
    return late, early.select("row", "doc_id", "n_words", "packed", "n_removed", "repeats", "kept", "kept_sha256")


def _unpacked(rows: DataFrame) -> DataFrame:
    """Replaces packed by text."""
    names = [c for c in rows.columns if c != "packed"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                text = pa.array([unpack(t.as_py()).decode("utf-8") for t in part.column("packed")], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), text], [*names, "text"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "text string"]))


def without_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the repeated words gone; a text that loses none keeps its bytes. n_chars, if present, is set anew."""
    text = F.coalesce("kept", F.when(F.col("row_null"), F.lit(None).cast("string")).otherwise(F.col("text")))
    marked = docs.withColumn("_null_text", F.col("text").isNull())
    late, early = _late_and_early(marked, n, SEED, keep=True, digest=False, whole=True)
    out = late.select("row", "kept", "text").unionAll(_unpacked(early.select("row", "kept", "packed")))
    out = out.withColumn("row_null", F.col("row._null_text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("kept").isNotNull(), F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)


def brute_force(rows: list[tuple[int, str | None]], n: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of all windows: n_words, n_removed and the digest of the words kept. For tests."""
    first: dict[tuple, int] = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, words in split.items():
        for a in range(len(words) - n + 1):
            key = tuple(words[a : a + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, words in split.items():
        places = [a for a in range(len(words) - n + 1) if first[tuple(words[a : a + n])] < i]
        cover = covered(len(words), places, n) if places else np.zeros(len(words), dtype=bool)
        kept = b" ".join(w for w, c in zip(words, cover) if not c)
        out[i] = (len(words), int(cover.sum()), hashlib.sha256(kept).hexdigest())
    return out
