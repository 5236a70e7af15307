"""Byte-pair encoding by a segment tree over adjacent pair ranks, and lossless decoding.

A text is cut at the strings of added tokens (unless they are plain text), then
into pretokens: contractions, runs of letters, of digits or of other signs with
one space in front, and white space. The bytes of a pretoken are its first
symbols. A segment tree holds, for every symbol, the key (rank of the pair that
the symbol makes with its right neighbour, place); inner nodes hold the least
key below them, so the root is the leftmost pair of the lowest rank. Its two
symbols become one, three leaves change (the pair itself, the one before, the
one that is gone), and each change climbs the tree in a logarithmic number of
steps. When the root holds no pair, the symbols left are the tokens.

Pretokens of a batch that were not met before are merged side by side, one step
of all trees at a time (``merge_many``); a long one has a tree of its own
(``merge_one``), so a text without any space costs n log n. Results are kept per
worker, up to KNOWN pretokens, then started anew; they do not depend on it.

Which code points are letters, digits or white space is asked of the given
tokenizer file's own rules once, on the driver, as Unicode versions differ.

Defined cases: null and empty texts have no tokens and decode to the empty text.
Very long texts and pretokens are encoded whole. Repeated rows and ids are
encoded row by row, with equal results for equal texts; nothing depends on the
order of rows, so there are no ties beyond the leftmost rule.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
KNOWN = 250_000  # pretokens whose tokens a worker keeps
KEPT_BYTES = 64  # longer pretokens are not kept
LONG = 256  # bytes from which a pretoken has a tree of its own
CELLS = 1 << 21  # tree nodes merged side by side
ROWS = 256  # texts encoded at once
ID = np.dtype("<i4")
NONE = np.int64(1) << np.int64(62)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Merges:
    """A byte-level vocabulary with its merges, and the classes of all code points."""

    tokens: tuple[bytes, ...]  # by id
    first: tuple[int, ...]  # id of each byte
    pairs: np.ndarray  # sorted keys left * len(tokens) + right
    ranks: np.ndarray  # rank of each pair
    made: np.ndarray  # id that the merge of each rank makes
    added: tuple[tuple[str, int], ...]  # added tokens
    classes: np.ndarray  # byte that stands for each code point in WORD


def _classes(pre) -> np.ndarray:
    """Letters become A, digits 0, white space a tab and the rest an exclamation mark, as the tokenizer's own rules say; ASCII stays where it fits.

    Behind a ! all signs but letters, digits and white space join it, behind an a letters do, behind a 1 digits do.
    A block of code points that joins its probe as one run needs no probe of each.
    """
    out = np.full(0x110000, 9, np.uint8)
    for begin in range(0, 0x110000, 256):
        left = [c for c in range(begin, begin + 256) if not 0xD800 <= c < 0xE000]
        run = "".join(map(chr, left))
        for probe, mark in (("!", "!"), ("a", "A"), ("1", "0")):
            if left and len(pre.pre_tokenize_str(probe + run)) == 1:
                out[left] = ord(mark)
                left = []
        for probe, mark in (("!", "!"), ("a", "A"), ("1", "0")):
            text = "".join(f"{probe}{chr(c)}\n" for c in left)
            joined = {a for _, (a, b) in pre.pre_tokenize_str(text) if b - a == 2 and text[a] == probe}
            hits = [c for i, c in enumerate(left) if 3 * i in joined]
            out[hits] = ord(mark)
            left = [c for i, c in enumerate(left) if 3 * i not in joined]
    for c in range(128):
        own = bytes([c])
        kind = ord("A") if own.isalpha() else ord("0") if own.isdigit() else 9 if own.isspace() else ord("!")
        out[c] = c if out[c] == kind else out[c]
    return out


@functools.lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    """Vocabulary of a byte-level BPE file of the tokenizers library."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    added = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    tokens = [b""] * (max([*vocab.values(), *(i for _, i in added)]) + 1)
    for word, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in word)
    for word, i in added:
        tokens[i] = word.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] * len(tokens) + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    first = {letters[c]: vocab[c] for c in letters}
    classes = _classes(Tokenizer.from_file(path).pre_tokenizer)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    return Merges(tuple(tokens), tuple(first[b] for b in range(256)), keys[order], order.astype(np.int64), made, added, classes)


class Encoder:
    def __init__(self, merges: Merges):
        self.m, self.size = merges, len(merges.tokens)
        self.first = np.array(merges.first, np.int64)
        self.rank_of = dict(zip(merges.pairs.tolist(), merges.ranks.tolist()))
        self.names = [str(i) for i in range(self.size)]
        self.cut = re.compile("|".join(re.escape(t) for t, _ in sorted(merges.added, key=lambda t: -len(t[0])))) if merges.added else None
        self.added = {t: (i,) for t, i in merges.added}
        self.known: dict[bytes | tuple[int], bytes] = {}  # packed tokens of pretokens

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has no merge or a side is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.m.pairs, key), len(self.m.pairs) - 1)
        return np.where((self.m.pairs[at] == key) & (left >= 0) & (right >= 0), self.m.ranks[at], NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed tokens of words of at most LONG bytes, each with its own tree of 2 * width nodes."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for width in (1 << k for k in range(1, LONG.bit_length())):
            group = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            step = max(1, CELLS // (2 * width))
            for begin in range(0, len(group), step):
                part = group[begin : begin + step]
                for i, found in zip(part.tolist(), self._lockstep([words[i] for i in part], sizes[part], width)):
                    out[i] = found
        return out

    def _lockstep(self, words: list[bytes], sizes: np.ndarray, width: int) -> Iterator[bytes]:
        n, bits = len(words), width.bit_length() - 1
        # A place -1 (before the start) and a place width (behind the end) hold no symbol.
        symbol = np.full((n, width + 2), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        symbol[:, 1:-1][inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        rank = self.ranks(symbol[:, 1:-1], symbol[:, 2:])
        tree[:, width:] = np.where(rank < NONE, rank << bits | np.arange(width), NONE)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at = (root & (width - 1)) + 1
            gone = after[live, at]
            then, prior = after[live, gone], before[live, at]
            symbol[live, at] = self.m.made[root >> bits]
            symbol[live, gone] = -1
            after[live, at] = then
            before[live, np.minimum(then, width + 1)] = at
            own = symbol[live, at]
            right = self.ranks(own, np.where(then <= width, symbol[live, np.minimum(then, width + 1)], -1))
            left = self.ranks(np.where(prior >= 1, symbol[live, prior], -1), own)
            tree[live, width + gone - 1] = NONE
            tree[live, width + at - 1] = np.where(right < NONE, right << bits | at - 1, NONE)
            held = np.flatnonzero(prior >= 1)
            tree[live[held], width + prior[held] - 1] = np.where(left[held] < NONE, left[held] << bits | prior[held] - 1, NONE)
            leaves = [width + gone - 1, width + at - 1, width + np.maximum(prior, 1) - 1]
            for _ in range(bits):
                for k in range(3):
                    up = leaves[k] >> 1
                    tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
                    leaves[k] = up
            live = live[tree[live, 1] < NONE]
        flat = symbol[symbol >= 0].astype(ID).tobytes()
        ends = (ID.itemsize * np.cumsum((symbol >= 0).sum(axis=1))).tolist()
        return (flat[a:b] for a, b in zip([0, *ends], ends))

    def merge_one(self, word: bytes) -> bytes:
        """Packed tokens of one word of any length."""
        n, size, rank_of, made = len(word), self.size, self.rank_of, self.m.made
        width = 1 << max(1, (n - 1).bit_length())
        bits = width.bit_length() - 1
        none = int(NONE)
        symbol = [*(self.m.first[b] for b in word)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(symbol[i] * size + symbol[i + 1])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(place: int, key: int) -> None:
            i = width + place
            tree[i] = key
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                low = key if key < other else other
                if tree[i] == low:
                    return  # nothing above changes
                tree[i] = key = low

        while (root := tree[1]) < none:
            at = root & (width - 1)
            gone, own = after[at], int(made[root >> bits])
            then, prior = after[gone], before[at]
            symbol[at], symbol[gone], after[at] = own, -1, then
            put(gone, none)
            rank = None
            if then < n:
                before[then] = at
                rank = rank_of.get(own * size + symbol[then])
            put(at, none if rank is None else rank << bits | at)
            if prior >= 0:
                rank = rank_of.get(symbol[prior] * size + own)
                put(prior, none if rank is None else rank << bits | prior)
        return np.array([s for s in symbol if s >= 0], ID).tobytes()

    def pretokens(self, text: str) -> list[bytes]:
        if text.isascii():
            raw = text.encode()
            marks = raw.translate(self._ascii) if self._ascii is not None else raw
            if marks == raw:
                return WORD.findall(raw)
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            marks = self.m.classes[points].tobytes()
        ends = list(accumulate(map(len, WORD.findall(marks))))
        return [text[a:b].encode() for a, b in zip([0, *ends], ends)]

    @functools.cached_property
    def _ascii(self) -> bytes | None:
        """Table for ASCII texts, None if every ASCII sign stands for itself."""
        own = self.m.classes[:128].tobytes()
        return None if own == bytes(range(128)) else own + bytes(range(128, 256))

    def encode(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """Ids of every text. ``special``: strings of added tokens are tokens, otherwise plain text."""
        parts: list[list[bytes | tuple[int]]] = []
        for text in texts:
            found: list[bytes | tuple[int]] = []
            at = 0
            if special and self.cut is not None:
                for hit in self.cut.finditer(text):
                    found += self.pretokens(text[at : hit.start()])
                    found.append(self.added[hit.group()])
                    at = hit.end()
            parts.append(found + self.pretokens(text[at:] if at else text))
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        new = set(chain.from_iterable(parts)).difference(known)
        once = {t: np.array(t, ID).tobytes() for t in new if isinstance(t, tuple)}
        once.update((w, self.merge_one(w)) for w in new if isinstance(w, bytes) and len(w) > LONG)
        short = [w for w in new if w not in once]
        merged = dict(zip(short, self.merge_many(short)))
        once.update((w, ids) for w, ids in merged.items() if len(w) > KEPT_BYTES)
        known.update(merged)
        known.update(once)
        out = [np.frombuffer(b"".join(map(known.__getitem__, found)), ID) for found in parts]
        for word in once:
            del known[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.m.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids.tolist()))


_ENCODERS: dict[int, Encoder] = {}


def encoder(merges: Merges) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = hash((merges.tokens, merges.first))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(merges)
    return _ENCODERS[key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def encode(docs: DataFrame, merges: Merges, special: bool = True) -> DataFrame:
    """doc_id and tokens (array of ids, null for a null text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for part in _parts(batches):
            texts = part.column("text").to_pylist()
            found = coder.encode([t or "" for t in texts], special)
            tokens = pa.array([None if t is None else ids for t, ids in zip(texts, found)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), tokens], ["doc_id", "tokens"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, tokens array<int>")


def decode(encoded: DataFrame, merges: Merges) -> DataFrame:
    """doc_id and text of every row of doc_id, tokens; null tokens give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for part in _parts(batches):
            texts = [coder.decode(np.asarray(ids.values)) if ids.is_valid else None for ids in part.column("tokens")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tokens").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, merges: Merges) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them; ids stay in the task that made them."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for part in _parts(batches):
            found = coder.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(coder.listed(ids).encode()).hexdigest() for ids in found], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(ids).encode()).hexdigest() for ids in found], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_merges(spark: SparkSession) -> Merges:
    """The public 50,000-token vocabulary; the setting ocuspark.bpe.file names another file."""
    path = spark.conf.get("ocuspark.bpe.file", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return load_merges(path)
