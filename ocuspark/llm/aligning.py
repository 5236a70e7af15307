"""Alignment of two tokenizers over the same bytes, each distinct text once.

Texts are shuffled by their full text and counted, so that copies are tokenised
and aligned once, however many there are. Tokenizer A (byte-level merges) reads
the text with a space in front, tokenizer B (a SentencePiece model) puts that
space there itself. Byte offsets at which a token of A and one of B both end
cut both token rows into groups; the two tokens that end there are a link. How
often the corpus links a pair of ids is the sum over distinct texts of links in
the text times copies of the text. The measures of a text, then, are joined to
all documents that hold it.

Strings of special tokens inside a text are plain text to both.

Defined cases: null and empty texts, and texts whose bytes either tokenizer does
not give back (B writes a U+2581 of the text as a space), have no tokens, links
or groups: measures 0, groups ''. Very long texts are aligned whole. Rows that
share an id or a text are rows of their own with the measures of their text.
Ties for the highest count of a B id all count as best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocuspark.llm.bpe import ID, ROWS, Encoder, Merges, encoder
from ocuspark.llm.text import written
from ocuspark.operators.skew import split_join

KEY = ["k1", "k2"]  # the first 128 bits of a text's SHA-256
CODED = (
    "k1 bigint, k2 bigint, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, links array<bigint>"
)


@dataclass(frozen=True)
class Pieces:
    """Bytes of each id of tokenizer B, and its file's content."""

    model: bytes
    tokens: tuple[bytes, ...]


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    tokens = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(tokens)]
    return Pieces(model, tuple(raw))


class Aligner:
    def __init__(self, merges: Merges, pieces: Pieces):
        import sentencepiece

        self.a: Encoder = encoder(merges)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        self.bytes_b = pieces.tokens
        self.len_a = np.array([len(t) for t in merges.tokens])
        self.len_b = np.array([len(t) for t in pieces.tokens])
        self.size_b = len(pieces.tokens)
        names = np.array([str(i) for i in range(max(self.a.size, self.size_b))], object)
        self.names = [names + end for end in (",", "|", ";", "")]

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of every text; none where the bytes are not given back."""
        spaced = [" " + t if t else "" for t in texts]
        found = self.b.encode(texts, out_type=int, num_threads=1)
        for text, ids_a, ids_b in zip(spaced, self.a.encode(spaced, special=False), found):
            whole = text.encode()
            same = b"".join(map(self.bytes_b.__getitem__, ids_b)) == whole == b"".join(map(self.a.m.tokens.__getitem__, ids_a.tolist()))
            yield (ids_a, np.array(ids_b, ID)) if same else (np.zeros(0, ID), np.zeros(0, ID))

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, str]:
        """Linked pairs (a * size of B + b) in order, and the groups as text."""
        if not len(ids_a):
            return np.zeros(0, np.int64), ""
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        pairs = ids_a[at_a].astype(np.int64) * self.size_b + ids_b[at_b]
        # Tokens of A, then of B, of each group; a group's last token of A has a bar behind it, its last of B a semicolon.
        order = np.argsort(np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1]), kind="stable")
        comma, bar, semicolon, bare = self.names
        text_a, text_b = comma[ids_a], comma[ids_b]
        text_a[at_a] = bar[ids_a[at_a]]
        text_b[at_b] = semicolon[ids_b[at_b]]
        text_b[-1] = bare[ids_b[-1]]
        return pairs, "".join(np.concatenate([text_a, text_b])[order].tolist())


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(merges: Merges, pieces: Pieces) -> Aligner:
    key = hash((merges.tokens, merges.first, pieces.model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(merges, pieces)
    return _ALIGNERS[key]


@dataclass(frozen=True)
class Alignment:
    """What a corpus gives.

    texts: k1, k2, copies, n_a, n_b, n_groups, groups, and pairs with links (how often the text links each), one row per distinct text.
    pairs: pair, a, b, links (corpus-wide), texts (distinct texts that hold it), best (no pair of this b has more).
    """

    texts: DataFrame
    pairs: DataFrame
    docs: DataFrame

    def measures(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
        held = self.texts.select(*KEY, F.explode(F.arrays_zip("pairs", "links")).alias("link"))
        held = held.select(*KEY, F.col("link.pairs").alias("pair"), F.col("link.links").alias("n"))
        counts = self.pairs.select("pair", F.col("texts").alias("n"))
        small = self.pairs.select("pair", F.col("links").alias("of_pair"), "best")
        joined = split_join(held, small, ["pair"], spread=KEY, counts=counts)
        sums = joined.groupBy(*KEY).agg(
            F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("of_pair")).alias("count_sum")
        )
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
        own = written(self.texts.select(*KEY, "n_a", "n_b", "n_groups", digest).join(sums, KEY, "left"), "align-measures")
        out = split_join(self.docs, own, KEY, spread=["doc_id"], counts=self.texts.select(*KEY, F.col("copies").alias("n")), how="left")
        whole = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        return out.select("doc_id", *whole, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _key(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, p, 16), 16, -10).cast("bigint").alias(k) for p, k in zip((1, 17), KEY)]


def align(docs: DataFrame, merges: Merges, pieces: Pieces) -> Alignment:
    """Aligns every distinct text of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((merges, pieces))  # bounded by the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                texts = part.column("text").to_pylist()
                rows: list[tuple] = []
                for text, copies, (ids_a, ids_b) in zip(texts, part.column("copies").to_pylist(), aligner.tokens(texts)):
                    pairs, groups = aligner.align(ids_a, ids_b)
                    key = np.frombuffer(hashlib.sha256(text.encode()).digest()[:16], ">i8").tolist()
                    rows.append((*key, copies, len(ids_a), len(ids_b), len(pairs), groups, *np.unique(pairs, return_counts=True)))
                kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [field.split()[0] for field in CODED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distinct = slim.filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = written(distinct.mapInArrow(run, CODED), "align-texts")
    held = texts.select("copies", F.explode(F.arrays_zip("pairs", "links")).alias("link"))
    counts = held.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum(F.col("link.links") * F.col("copies")).alias("links"), F.count(F.lit(1)).alias("texts"))
    size_b = len(pieces.tokens)
    counts = written(counts.withColumn("b", (F.col("pair") % size_b).cast("int")), "align-counts")
    highest = counts.groupBy("b").agg(F.max("links").alias("most"))  # at most a row per id of B
    pairs = counts.join(F.broadcast(highest), "b").select(
        "pair", F.expr(f"pair div {size_b}").cast("int").alias("a"), "b", "links", "texts", (F.col("links") == F.col("most")).alias("best")
    )
    return Alignment(texts, written(pairs, "align-pairs"), slim.select("doc_id", *_key(F.coalesce("text", F.lit("")))))


def default_pieces(spark: SparkSession) -> Pieces:
    """The public 32,000-piece model; the setting ocuspark.pieces.model names another file."""
    path = spark.conf.get("ocuspark.pieces.model", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return load_pieces(path)
