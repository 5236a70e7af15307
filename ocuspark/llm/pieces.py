"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text, with one space put in front, is a lattice whose arcs are the pieces of a
given vocabulary (the piece mark U+2581 stands for the space). No piece goes on
across a word's end, so the lattice falls apart into chunks (spaces and the word
after them) that are filtered forward once each: the weight of all
segmentations of every prefix. Segmentations are then drawn backward, arc by
arc, with probabilities in proportion to weight ** ``sharpness``. The random
numbers are a hash of seed, row key, chunk number and step: reruns and retried
tasks draw the same. A character without a piece becomes its UTF-8 byte pieces,
and so does a U+2581 in the text itself, so decoding gives back every text.

The vocabulary of a merge model has ranks instead of probabilities; piece
weights then follow Zipf's law, 1 / (rank + 1). ``scores="model"`` takes the
model's scores as log weights.

Defined cases: null and empty texts have no pieces (null decodes to null). Rows
with equal keys and texts get equal pieces; a null key is a key of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocuspark.llm.text import U64, mix

MARK = "▁"
TABLE_CHUNKS = 150_000  # chunks whose lattices a worker keeps; it starts anew beyond
SLICE_CHUNKS = 100_000  # chunks drawn at once


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]  # text of each id, space for the mark; "" for ids never used as text
    weights: tuple[float, ...]
    byte_ids: tuple[int, ...]  # id of each byte

    @property
    def split(self) -> re.Pattern:
        """Chunks between which no piece goes on."""
        if any(" " in p.lstrip(" ") for p in self.pieces):
            return re.compile(r"(?s).+")
        return re.compile(r"\n| *[^ \n]+| +") if not any("\n" in p for p in self.pieces) else re.compile(r" *[^ ]+| +")


def load_vocabulary(path: str, scores: str = "zipf", sharpness: float = 1.0) -> Vocabulary:
    """Pieces of a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids, pieces, raw = [0] * 256, [], []
    for i in range(size):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        pieces.append("" if special else piece.replace(MARK, " "))
        raw.append(math.exp(score) if scores == "model" else 1.0 / (1.0 + min(-score, size)))
    total = sum(w for w, p in zip(raw, pieces) if p)
    return Vocabulary(tuple(pieces), tuple((w / total) ** sharpness for w in raw), tuple(byte_ids))


class _Codes:
    """Piece ids by the code points of a span, for many spans at once (open addressing)."""

    BITS = 18

    def __init__(self, ids: dict[str, int]):
        self.mask = (1 << self.BITS) - 1
        self.keys = np.zeros(1 << self.BITS, dtype=U64)
        self.values = np.full(1 << self.BITS, -1, dtype=np.int32)
        by_length: dict[int, list[str]] = {}
        for piece in ids:
            by_length.setdefault(len(piece), []).append(piece)
        for n, group in by_length.items():
            codes = np.frombuffer("".join(group).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
            state = np.zeros(len(group), dtype=U64)
            for j in range(n):
                state = self.grow(state, codes[:, j])
            for piece, key in zip(group, mix(state).tolist()):
                slot = key & self.mask
                while self.values[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.values[slot] = key, ids[piece]

    @staticmethod
    def grow(state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (state + code.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)

    def find(self, state: np.ndarray) -> np.ndarray:
        key = mix(state)
        slot = (key & U64(self.mask)).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        open_ = np.flatnonzero((out.ravel() < 0) & (self.values[slot].ravel() >= 0))
        flat, keys, slots = out.ravel(), key.ravel(), slot.ravel()
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            here = slots[open_]
            hit = (self.keys[here] == keys[open_]) & (self.values[here] >= 0)
            flat[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (self.values[here] >= 0)]
        return flat.reshape(out.shape)


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 12, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            more = np.zeros(max(need, len(self.data) * 3 // 2), dtype=self.data.dtype)
            more[: self.size] = self.data[: self.size]
            self.data = more
        self.data[self.size : need] = values
        self.size = need


class Sampler:
    """Draws segmentations; keeps the filtered lattices of the chunks it has met."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        self.v, self.seed = vocabulary, seed
        ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.longest = max(map(len, ids))
        self.codes = _Codes(ids)
        self.weights = np.array(vocabulary.weights)
        self.split = vocabulary.split
        self.rare = float(min(vocabulary.weights))
        self.as_bytes = [p.encode() for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.byte_ids):
            self.as_bytes[i] = bytes([value])
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.last = _Grown(np.int32)  # last node of a chunk
        self.first_arc = _Grown(np.int32)  # first arc into a node, the longest
        self.upto = _Grown(np.float32)  # cumulative probability within the node
        self.before = _Grown(np.int32)  # node an arc comes from; -1: the chunk's start
        self.piece = _Grown(np.int32)  # id, or -1 - code point for bytes
        self.width = _Grown(np.int8)  # ids an arc stands for

    def _filter(self, new: list[str]) -> None:
        """Forward pass over new chunks, those of one length together."""
        new.sort(key=len)
        i = 0
        while i < len(new):
            n = len(new[i])
            j = i + 1
            most = max(1, 400_000 // (n * min(n, self.longest)))
            while j < len(new) and len(new[j]) == n and j - i < most:
                j += 1
            self._filter_equal(new[i:j], n)
            i = j

    def _filter_equal(self, chunks: list[str], n: int) -> None:
        m, wide = len(chunks), min(n, self.longest)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4").reshape(m, n)
        ids, weight = [], []  # by length - 1, over the starts
        state = np.zeros((m, n), dtype=U64)
        for length in range(1, wide + 1):
            state = self.codes.grow(state[:, : n - length + 1], codes[:, length - 1 :])
            found = self.codes.find(state)
            w = np.where(found >= 0, self.weights[found], 0.0)
            if length == 1:
                raw = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
                missing = found < 0
                w = np.where(missing, self.rare ** raw.astype(np.float64), w)
                found = np.where(missing, -1 - codes.astype(np.int64), found).astype(np.int32)
                bytes_of = np.where(missing, raw, 1).astype(np.int8)
            ids.append(found)
            weight.append(w)
        mass = np.zeros((m, n + 1))
        mass[:, 0] = 1.0
        share = np.zeros((m, n, wide))  # of the arcs into a node, longest first
        for e in range(1, n + 1):
            for length in range(1, min(wide, e) + 1):
                share[:, e - 1, wide - length] = mass[:, e - length] * weight[length - 1][:, e - length]
            total = share[:, e - 1].sum(axis=1)
            share[:, e - 1] /= total[:, None]
            mass[:, e] = total
            if total.min() < 1e-60:  # keep the nodes that later arcs reach away from zero
                low = max(0, e + 1 - self.longest)
                mass[:, low : e + 1] = np.minimum(mass[:, low : e + 1] / mass[:, e : e + 1], 1e200)
        keep = share > 0
        keep[:, :, wide - 1] |= ~keep.any(axis=2)
        counts = keep.sum(axis=2).ravel()
        upto = np.cumsum(share, axis=2)[keep].astype(np.float32)
        ends = np.cumsum(counts)
        upto[ends - 1] = 2.0
        node0, arc0 = self.first_arc.size, self.upto.size
        at = np.arange(n)[:, None] - np.arange(wide, 0, -1)[None, :]  # e - 1 - length: place among nodes, -1: the start
        before = np.where(at >= 0, node0 + at + (np.arange(m) * n)[:, None, None], -1)[keep]
        pieces = np.zeros((m, n, wide), dtype=np.int32)
        widths = np.ones((m, n, wide), dtype=np.int8)
        for length in range(1, wide + 1):
            pieces[:, length - 1 :, wide - length] = ids[length - 1]
        widths[:, :, wide - 1] = bytes_of
        self.upto.extend(upto)
        self.before.extend(before.astype(np.int32))
        self.piece.extend(pieces[keep])
        self.width.extend(widths[keep])
        self.first_arc.extend((arc0 + ends - counts).astype(np.int32))
        self.last.extend((node0 + np.arange(1, m + 1) * n - 1).astype(np.int32))
        base = len(self.chunks)
        self.chunks.update(zip(chunks, range(base, base + m)))

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of every text, drawn with its key."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = begin = 0
        for text in texts:
            held.append(self.split.findall(" " + text) if text else [])
            size += len(held[-1])
            if size > SLICE_CHUNKS:
                out += self._encode(held, keys[begin : begin + len(held)])
                begin, size, held = begin + len(held), 0, []
        return out + self._encode(held, keys[begin:])

    def _encode(self, held: list[list[str]], keys: np.ndarray) -> list[np.ndarray]:
        if len(self.chunks) > TABLE_CHUNKS:
            self._clear()
        known = self.chunks
        self._filter(list({c for found in held for c in found if c not in known}))
        numbers = [known[c] for found in held for c in found]
        return self._draw(numbers, [len(found) for found in held], keys)

    def _draw(self, numbers: list[int], counts: list[int], keys: np.ndarray) -> list[np.ndarray]:
        if not numbers:
            return [np.zeros(0, dtype=np.int32) for _ in counts]
        first, upto, before = self.first_arc.data, self.upto.data, self.before.data
        piece, width = self.piece.data, self.width.data
        per_row = np.array(counts, dtype=np.int64)
        row = np.repeat(np.arange(len(counts)), per_row)
        at = np.arange(len(numbers)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        state = mix(keys.astype(U64)[row] + mix(at.astype(U64) + mix(np.full(1, self.seed, dtype=U64))))
        node = self.last.data[np.array(numbers, dtype=np.int64)]
        occurrence = np.arange(len(numbers))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.zeros(len(numbers), dtype=np.int64)
        step = 0
        while len(node):
            step += 1
            u = (mix(state + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) * 2.0**-53
            arc = first[node]
            more = np.flatnonzero(u >= upto[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] >= upto[arc[more]]]
            total[occurrence] += width[arc]
            steps.append((occurrence, arc))
            node = before[arc]
            go = np.flatnonzero(node >= 0)
            node, occurrence, state = node[go], occurrence[go], state[go]
        end = np.cumsum(total)
        flat = np.zeros(int(end[-1]), dtype=np.int32)
        cursor = end.copy()
        for occurrence, arc in steps:
            ids, wide = piece[arc], width[arc].astype(np.int64)
            cursor[occurrence] -= wide
            whole = ids >= 0
            flat[cursor[occurrence[whole]]] = ids[whole]
            for o, i in zip(occurrence[~whole].tolist(), ids[~whole].tolist()):
                place = cursor[o]
                for k, b in enumerate(chr(-1 - i).encode()):
                    flat[place + k] = self.v.byte_ids[b]
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(per_row)])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that gave the ids."""
        return b"".join(map(self.as_bytes.__getitem__, ids.tolist()))[1:]


_SAMPLERS: dict[int, Sampler] = {}


def _sampler(vocabulary: Vocabulary, seed: int) -> Sampler:
    """One sampler a worker and vocabulary, so that tasks share the lattices."""
    key = hash((vocabulary.pieces, vocabulary.weights, seed))
    if key not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[key] = Sampler(vocabulary, seed)
    return _SAMPLERS[key]


def _keys(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.cast(pa.int64()).fill_null(-(1 << 62))).view(U64)


def encode(docs: DataFrame, vocabulary: Vocabulary, seed: int = 1) -> DataFrame:
    """doc_id and pieces (array of ids, null for a null text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared.value, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                drawn = sampler.encode([t or "" for t in texts], _keys(part.column("doc_id")))
                pieces = pa.array([None if t is None else d for t, d in zip(texts, drawn)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pieces], ["doc_id", "pieces"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, pieces array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of every row of doc_id, pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared.value, 0)
        for batch in batches:
            texts = [sampler.decode(np.asarray(p.values)).decode() if p.is_valid else None for p in batch.column("pieces")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id bigint, text string")


def encode_digests(docs: DataFrame, vocabulary: Vocabulary, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as 32-bit little-endian numbers) and lossless (decoded again, the text is the same).

    The pieces stay in the task that drew them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared.value, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                drawn = sampler.encode(texts, _keys(part.column("doc_id")))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(d) for d in drawn], pa.int64()),
                        pa.array([hashlib.sha256(d.astype("<i4").tobytes()).hexdigest() for d in drawn]),
                        pa.array([sampler.decode(d) == t.encode() for d, t in zip(drawn, texts)]),
                    ],
                    ["doc_id", "n_pieces", "pieces_sha256", "lossless"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_pieces bigint, pieces_sha256 string, lossless boolean")


def default_vocabulary(spark: SparkSession) -> Vocabulary:
    """The public 32,000-piece model; the setting ocuspark.pieces.model names another file."""
    path = spark.conf.get("ocuspark.pieces.model", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return load_vocabulary(path)
