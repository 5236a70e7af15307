"""Near duplicates by the general rule: five-word shingles, Jaccard similarity 0.8 or more.

The first candidates come from op9's method: fingerprints within three bits, found by
the generalised pigeonhole of ``simhash.hamming_links``. Edited copies lie further
apart, up to eleven bits were seen, so MinHash bands give more candidates, and a last
step looks for what both left in different components.

These candidates share one of BANDS MinHash bands of MINIMA minima over a text's
shingles; two texts of similarity 0.8 share none with a chance of
(1 - 0.8 ** MINIMA) ** BANDS, which is 5e-8, and less above. Candidates first
compare sketches, a byte of each of their 128 minima: a pair at 0.8 agrees in 102
places on average and in fewer than the 71 asked for with a chance of 8e-11. Those
left are compared by the exact similarity of the whole texts, so nothing else links.

A large group is not paired with itself: the texts of a band meet the band's
smallest only. Those that lie in different components after that meet where they
share a rare shingle: two sets with so much in common share one of the first few of
each in any one order, and rarest first few pairs do. The parities of their shingles
in PARITY cells then differ in no more cells than they have shingles not in common.
Neither rule loses a pair (``_sharing_rare``); the components are those of all pairs.

Defined cases: words are lowered (ASCII); texts of fewer words than a shingle
are one shingle; null and empty texts are alike. Repeated rows and ids as in
``simhash.keep_representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.llm.simhash import components, hamming_links, keep_named
from ocuspark.llm.text import U64, mix, removed, span_hashes, written

WIDTH = 5  # words of a shingle
FP_WIDTH = 3  # words of a shingle of the fingerprint
SIMILARITY = 0.8
BANDS, MINIMA = 32, 4
ROWS = 256  # texts sketched at once
AT_ONCE = 512  # shingles whose hashes are made at once: half a MB
AGREE = 0.7  # of the places of two sketches that a pair at the threshold shares on average
RUN = 1000  # pairs of one text that are compared in a row
PARITY = 512  # cells of a text's parities
BITS_APART = 3  # of two fingerprints that the pigeonhole brings together
_SEEDS = mix(np.arange(1, 2 * BANDS * MINIMA + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, -1, 1)
_ODD = _SEEDS[1] | U64(1)


def _hashes(text: bytes, *widths: int) -> list[np.ndarray]:
    """Hashes of the runs of each width of lowered words joined by one space, with one pass over the text."""
    if not text:
        return [np.zeros(0, U64)] * len(widths)
    body = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(body == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(body))
    runs = [min(width, len(starts)) for width in widths]
    first = [starts[: len(starts) - n + 1] for n in runs]
    last = [ends[n - 1 :] for n in runs]
    found = span_hashes(body, np.concatenate(first), np.concatenate(last))
    return np.split(found, np.cumsum([len(x) for x in first])[:-1])


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lowered words joined by one space."""
    return np.unique(_hashes(text, width)[0])


def fingerprint(hashes: np.ndarray) -> int:
    """As ``simhash.simhash``: the bits that are one in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(hashes), bitorder="little").view(U64)[0])


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * MINIMA hash functions over the shingles."""
    low = np.full(BANDS * MINIMA, ~U64(0))
    for i in range(0, len(own), AT_ONCE):
        mixed = own[None, i : i + AT_ONCE] ^ _SEEDS[0]
        mixed *= _ODD
        np.minimum(low, mixed.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key per band of minima, for a row of minima or several."""
    low, keys = low.reshape(*low.shape[:-1], BANDS, MINIMA), np.arange(1, BANDS + 1, dtype=U64)
    for r in range(MINIMA):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) ^ low[..., r])
    return keys


def sketch(low: np.ndarray) -> bytes:
    """Eight bits of every minimum: equal where the minima are, else by a chance of 1 / 256."""
    return (low >> U64(24)).astype(np.uint8).tobytes()


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of PARITY cells, 64 cells a number."""
    return np.packbits(np.bincount(own & U64(PARITY - 1), minlength=PARITY).astype(np.uint8) & 1).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, class (a hash of the words), size in shingles, fingerprint, band keys, sketch, parities and the packed words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                classes, sizes, fps, low, sketches, odd, packed = [], [], [], [], [], [], []
                for t in part.column("text").cast(pa.large_binary()):
                    words = b" ".join((t.as_py() or b"").lower().split())
                    own, short = _hashes(words, WIDTH, FP_WIDTH)
                    own = np.unique(own)
                    classes.append(xxhash.xxh64_intdigest(words))
                    sizes.append(len(own))
                    fps.append(fingerprint(short))
                    low.append(minima(own))
                    sketches.append(sketch(low[-1]))
                    odd.append(parities(own))
                    packed.append(squeeze(words))
                # A text without words has one key of its own kind.
                keys = [k.view(np.int64) if size else np.zeros(1, np.int64) for k, size in zip(band_keys(np.array(low)), sizes)]
                columns = [
                    part.column("doc_id"), pa.array(np.array(classes, U64).view(np.int64)), pa.array(sizes, pa.int32()),
                    pa.array(np.array(fps, U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                    pa.array(odd, pa.list_(pa.int64())), pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "size", "fp", "keys", "sketch", "odd", "packed"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, class bigint, size int, fp bigint, keys array<bigint>, sketch binary, odd array<bigint>, packed binary")


def _promising(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs a, b whose sketches agree in at least ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * MINIMA) for c in ("sa", "sb"))
            near = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(near)

    sa = sketches.select(F.col("class").alias("a"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("class").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose whole texts are similar enough.

    Pairs of one a lie together, cut into runs of about RUN by a hash of b. The
    text of b travels with its pair, that of a once a run, in front of it; a
    task holds one text of each at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        head = own = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            near = []
            for i, text in enumerate(batch.column("packed")):
                if b[i] is None:
                    head, own = a[i], shingles(unpack(text.as_py()))
                    continue
                assert a[i] == head
                both = np.concatenate([own, shingles(unpack(text.as_py()))])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if shared >= similarity * (len(both) - shared):
                    near.append(i)
            found = [pa.array([c[i] for i in near], pa.int64()) for c in (a, b)]
            yield pa.RecordBatch.from_arrays(found, ["a", "b"])

    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    cut = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), "runs").cast("int")).select("a", "b", "run")
    heads = cut.select("a", "run").distinct().join(texts.withColumnRenamed("class", "a"), "a").select("a", F.lit(None).cast("bigint").alias("b"), "run", "packed")
    rows = cut.join(texts.withColumnRenamed("class", "b"), "b").select("a", "b", "run", "packed").unionAll(heads)
    laid = rows.repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    return laid.mapInArrow(run, "a bigint, b bigint")


def _fits(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= similarity * F.greatest(x, y)


def _fingerprint_pairs(classes: DataFrame, scratch: list[str]) -> DataFrame:
    """a, b: the first class of a fingerprint with its other classes, and with the first of each fingerprint within BITS_APART."""
    first = written(classes.groupBy("fp").agg(F.min("class").alias("first")), "similar-fingerprints", scratch)
    same = classes.join(first, "fp").filter(F.col("class") != F.col("first")).select(F.col("first").alias("a"), F.col("class").alias("b"))
    links = hamming_links(first.select("fp"), BITS_APART).toDF("fa", "fb")
    x, y = first.toDF("fa", "a"), first.toDF("fb", "b")
    return same.unionAll(links.join(x, "fa").join(y, "fb").select("a", "b"))


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """class, size, root and shingle: every shingle of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, text in enumerate(batch.column("packed")):
                own = shingles(unpack(text.as_py()))
                same = [batch.column(c).take(pa.array(np.full(len(own), i))) for c in ("class", "size", "root")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(own.view(np.int64))], ["class", "size", "root", "shingle"])

    return texts.select("class", "size", "root", "packed").mapInArrow(run, "class bigint, size int, root bigint, shingle bigint")


def _sharing_rare(texts: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """Pairs a, b of texts (class, size, root, odd, packed) with different roots that may be similar enough; no other pair is.

    Sets of x and y elements with a similarity of s share at least
    s / (1 + s) * (x + y) of them. Ordered rarest first, they then share one
    within the first x - that + 1 of one and y - that + 1 of the other. A text
    with many shingles of its own has none but these there and meets nobody. At
    most (1 - s) / (1 + s) * (x + y) are not shared, and each changes one parity.
    """
    rows = written(_shingle_rows(texts), "similar-shingles", scratch)
    held = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "similar-held", scratch)
    # Those of one text come first; only their number matters.
    shared = rows.join(held, "shingle")
    order = Window.partitionBy("class").orderBy("n", "shingle")
    whole = Window.partitionBy("class")
    place = F.row_number().over(order) + F.col("size") - F.count(F.lit(1)).over(whole)
    most = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1
    first = shared.withColumn("place", place).filter(F.col("place") <= most).select("shingle", "class", "size", "root", "place")
    first = written(first, "similar-rare", scratch)
    # In a shingle's list the texts of its largest component meet the others only.
    roots = first.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = roots.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    largest = written(largest.select("shingle", F.col("top.root").alias("top")), "similar-largest", scratch)
    listed = written(first.join(largest, "shingle").withColumn("other", F.col("root") != F.col("top")).drop("top").join(texts.select("class", "odd"), "class"), "similar-listed", scratch)
    x, y = listed.filter("other").alias("x"), listed.alias("y")
    common = F.ceil(similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6)
    early = (F.col("x.place") <= F.col("x.size") - common + 1) & (F.col("y.place") <= F.col("y.size") - common + 1)
    differ = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(PARITY // 64)), F.lit(0))
    alike = differ <= (1 - similarity) / (1 + similarity) * (F.col("x.size") + F.col("y.size")) + 1e-6
    once = (~F.col("y.other") | (F.col("x.root") < F.col("y.root"))) & (F.col("x.root") != F.col("y.root"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & once & _fits("x.size", "y.size", similarity) & early & alike)
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def similar_components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class and component_id (the smallest doc_id of the component) of every row of docs."""
    scratch: list[str] = []
    rows = written(_sketches(docs), "similar-rows", scratch)
    classes = rows.groupBy("class").agg(
        F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch"), F.first("odd").alias("odd"), F.first("packed").alias("packed"),
    )
    classes = written(classes, "similar-classes", scratch)

    def texts_of(asked: DataFrame) -> DataFrame:
        return classes.select("class", "packed").join(asked.select("class"), "class", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(_promising(pairs, classes, int(AGREE * similarity * BANDS * MINIMA)), "similar-near", scratch)
        texts = written(texts_of(near.select(F.explode(F.array("a", "b")).alias("class"))), "similar-texts", scratch)
        return written(_verified(near, texts, similarity), "similar-links", scratch)

    # By fingerprint, and the smallest of a band with its others. A band's row is written: Spark splits the hot keys of the other side.
    keys = classes.select("class", "size", F.explode("keys").alias("key"))
    bands = keys.groupBy("key").agg(F.min(F.struct("class", "size")).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = written(bands.select("key", F.col("low.class").alias("low"), F.col("low.size").alias("low_size")), "similar-bands", scratch)
    met = keys.join(bands, "key").filter(F.col("class") != F.col("low")).filter(_fits("size", "low_size", similarity))
    met = _fingerprint_pairs(classes, scratch).unionAll(met.select(F.col("low").alias("a"), F.col("class").alias("b")))
    met = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-stars", scratch)
    links = linked(met)
    roots = written(components(links), "similar-roots", scratch)
    # What lies apart in one band after that, by rare shingles.
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "size", "keys", F.coalesce("root", "class").alias("root"))
    rooted = written(rooted, "similar-rooted", scratch)
    keys = rooted.select("class", "size", "root", F.explode("keys").alias("key"))
    split = written(keys.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key"), "similar-split", scratch)
    asked = written(keys.join(split, "key").select("class", "size", "root").distinct(), "similar-asked", scratch)
    if not asked.isEmpty():
        apart = _sharing_rare(asked.join(classes.select("class", "odd", "packed"), "class"), similarity, scratch)
        apart = written(apart.join(met, ["a", "b"], "left_anti"), "similar-apart", scratch)
        stars = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = written(components(stars.unionAll(linked(apart))), "similar-roots", scratch)
    named = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "doc", F.coalesce("root", "class").alias("root"))
    named = written(named, "similar-named", scratch)
    best = written(named.groupBy("root").agg(F.min("doc").alias("component_id")), "similar-components", scratch)
    members = named.join(best, "root").select("class", "component_id")
    placed_rows = written(rows.select("doc_id", "class").join(members, "class"), "similar-members")
    removed(docs.sparkSession, scratch)
    return placed_rows


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component."""
    return keep_named(docs, similar_components(docs, similarity))
