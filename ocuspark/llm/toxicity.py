"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words sums over their common subsequences of LENGTH characters
the products of decay ** gaps, where a subsequence may spread over SPAN
characters, so inserted characters lower a match instead of losing it. Words are
lower-cased and get marks of start and end. Runs of one-letter words, and words with
marks between their letters, are also read as one word.
Nystrom landmarks (words of both classes) give features K(x, L) K(L, L)^-1/2 for a
linear machine with hinge loss. Its decision is linear in the subsequences, so
the landmarks collapse into one table of subsequence weights, and a word costs
one look-up a subsequence.

Words are taught from sentences of labelled documents: those that set toxic
documents apart are positive, words of clean ones negative, both also with a
character inserted or spaced out. A sentence is as toxic as its worst word, a
document as its two worst; a logistic curve on labelled documents calibrates.
Its slopes are never negative, so a further word never lowers a score.

Fitted on at most ``documents`` labelled documents a class. Every document is
scored whole. Defined cases: null and empty texts take the lowest decision
value; without labels of both classes every score is the base rate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.llm.quality import logistic_fit
from ocuspark.llm.text import U64, held_out, mix, written

LENGTH, SPAN, DECAY = 4, 7, 0.6
LONGEST = 24  # longer words are read in overlapping pieces of this length
LANDMARKS = 360
SHARE = 0.015  # of toxic documents that a word must be found in to be taught as toxic
FLOOR = -2.0  # decision value of a text without words
KNOWN_WORDS = 400_000  # decision values a worker keeps

#: Offsets of the later characters of a subsequence.
_SHAPES = [(*inner, last) for last in range(LENGTH - 1, SPAN) for inner in combinations(range(1, last), LENGTH - 2)]
_STEP = 0x9E3779B97F4A7C15


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the subsequences of words of one length (a row each)."""
    n = len(words[0])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(U64) + U64(1)
    out, weight = [], []
    for shape in _SHAPES:
        if n > shape[-1]:
            state = letters[:, : n - shape[-1]]
            for at in shape:
                state = state * U64(_STEP) + letters[:, at : n - shape[-1] + at]
            out.append(state)
            weight.append(np.full(n - shape[-1], DECAY ** (shape[-1] - LENGTH + 1)))
    if not out:
        return np.zeros((len(words), 0), dtype=np.int64), np.zeros(0)
    # A free slot of the weight table is -1; codes are never negative.
    return (mix(np.concatenate(out, axis=1)) >> U64(1)).astype(np.int64), np.concatenate(weight)


def _norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself; repeated subsequences add up first."""
    order = np.argsort(codes, axis=1)
    flat = np.take_along_axis(codes, order, axis=1)
    new = np.ones(flat.shape, dtype=bool)
    new[:, 1:] = flat[:, 1:] != flat[:, :-1]
    sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
    first = np.concatenate([[0], np.cumsum(new.sum(axis=1))[:-1]])
    return np.sqrt(np.add.reduceat(sums**2, first))


def _marked(word: str) -> str:
    """The word between marks of its start and its end."""
    return "^" + word + "$" * max(1, LENGTH - 1 - len(word))


Profile = tuple[np.ndarray, np.ndarray]  # distinct codes in order, and their weights over the norm


@lru_cache(maxsize=30_000)
def _profile(word: str) -> Profile:
    codes, weight = subsequences([_marked(word)])
    distinct, at = np.unique(codes[0], return_inverse=True)
    values = np.bincount(at, weights=weight, minlength=len(distinct))
    return distinct, values / (np.sqrt((values**2).sum()) or 1.0)


def kernel(a: list[Profile], b: list[Profile], block: int = 250) -> np.ndarray:
    """Normalised kernel of two lists of profiles, over the subsequences that b has."""
    known = np.unique(np.concatenate([codes for codes, _ in b] or [np.zeros(0, np.int64)]))

    def dense(part: list[Profile]) -> np.ndarray:
        out = np.zeros((len(part), len(known)), dtype=np.float32)
        for row, (codes, values) in zip(out, part):
            at = np.searchsorted(known, codes)
            have = at < len(known)
            have[have] = known[at[have]] == codes[have]
            row[at[have]] = values[have]
        return out

    right = dense(b).T
    return np.concatenate([dense(a[i : i + block]) @ right for i in range(0, len(a), block)] or [np.zeros((0, len(b)))]).astype(np.float64)


@dataclass(frozen=True)
class ToxicityModel:
    codes: np.ndarray  # open addressing: -1 is free
    weights: np.ndarray
    offset: float
    curve: tuple[float, ...]  # worst word, second worst word, offset

    def probability(self, values: np.ndarray) -> np.ndarray:
        line = values @ np.array(self.curve[:-1]) + self.curve[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(line, -30.0, 30.0)))


def _slot(codes: np.ndarray, size: int) -> np.ndarray:
    return (mix(codes.astype(np.int64).view(U64)) & U64(size - 1)).astype(np.int64)


def _hash_table(weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (8 * len(weights)).bit_length())
    keys, values = np.full(size, -1, dtype=np.int64), np.zeros(size)
    for code, at in zip(weights, _slot(np.array(list(weights) or [0], dtype=np.int64), size).tolist()):
        while keys[at] >= 0:
            at = (at + 1) & (size - 1)
        keys[at], values[at] = code, weights[code]
    return keys, values


def _pieces(word: str) -> list[str]:
    """A longer word in overlapping pieces of LONGEST characters."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Judge:
    """Decision values of words and documents under a model."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.known: dict[str, float] = {}

    def _look_up(self, codes: np.ndarray) -> np.ndarray:
        keys, values = self.model.codes, self.model.weights
        size = len(keys)
        at = _slot(codes, size)
        out = np.where(keys[at] == codes, values[at], 0.0)
        rows = np.flatnonzero((keys[at] != codes).ravel() & (keys[at] >= 0).ravel())
        flat, slots, want = out.ravel(), at.ravel(), codes.ravel()
        while len(rows):
            slots[rows] = (slots[rows] + 1) & (size - 1)
            here = keys[slots[rows]]
            hit = here == want[rows]
            flat[rows[hit]] = values[slots[rows[hit]]]
            rows = rows[~hit & (here >= 0)]
        return flat.reshape(out.shape)

    def _values(self, words: list[str]) -> list[float]:
        codes, weight = subsequences(words)
        out = np.full(len(words), self.model.offset)
        if codes.shape[1]:
            above = self._look_up(codes) @ weight
            some = np.flatnonzero(above != 0)
            if len(some):
                out[some] += above[some] / _norms(codes[some], weight)
        return out.tolist()

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, set[str]] = {}
        forms = {w: [p for r in readings(w) for p in _pieces(r)] for w in words}
        for parts in forms.values():
            for p in parts:
                by_length.setdefault(len(p), set()).add(p)
        values: dict[str, float] = {}
        for group in by_length.values():
            ordered = sorted(group)
            for i in range(0, len(ordered), 4096):
                part = ordered[i : i + 4096]
                values.update(zip(part, self._values([_marked(p) for p in part])))
        self.known.update((w, max(values[p] for p in parts)) for w, parts in forms.items())

    def worst(self, texts: list[str]) -> np.ndarray:
        """The two highest decision values of the distinct words of every text."""
        out = np.full((len(texts), 2), FLOOR)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        bags = [units(t) for t in texts]
        known = self.known
        self.learn({w for bag in bags for w in bag if w not in known})
        for i, bag in enumerate(bags):
            if len(bag) > 1:
                values = np.fromiter((known[w] for w in bag), dtype=np.float64, count=len(bag))
                values.partition(len(values) - 2)
                out[i] = values[-1], values[-2]
            elif bag:
                out[i, 0] = known[next(iter(bag))]
        return np.maximum(out, FLOOR)


_SPACED = re.compile(r"(?<!\S)(?:\w\s+){2,}\w(?!\w)")
_GAPPED = re.compile(r"\w[^\w\s]+\w")
_MARKS = re.compile(r"[^\w\s]+")
_REPEATED = re.compile(r"(\w)\1{2,}")


def units(text: str) -> set[str]:
    """Distinct lower-case words, and runs of one-letter words read as one."""
    low = text.lower()
    out = set(low.split())
    for run in _SPACED.findall(low):
        out.add("".join(run.split()))
    return out


def readings(word: str) -> list[str]:
    """The word, and where they differ also without the marks between its letters and with letters that
    come three times or more in a row once. A word counts as its worst reading, once."""
    if not _GAPPED.search(word) and not _REPEATED.search(word):
        return [word]
    return [word, _REPEATED.sub(r"\1", _MARKS.sub("", word))]


def _variants(word: str, turn: int) -> list[str]:
    """A character inserted, and a separator between all letters."""
    at = 1 + turn % max(1, len(word) - 1)
    return [word, word[:at] + "-*_.x"[turn % 5] + word[at:], ".-*_"[turn % 4].join(word)]


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    pull = ridge * np.eye(z.shape[1])
    pull[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    inside = np.ones(len(y), dtype=bool)
    for _ in range(60):
        part = z[inside] * cost[inside, None]
        new = np.linalg.solve(pull + part.T @ z[inside], part.T @ y[inside])
        w, before = (new + w) / 2 if _ > 20 else new, inside
        inside = y * (z @ w) < 1
        if (inside == before).all():
            break
    return w


Miner = Callable[[dict[int, float], float], list[str]]


def train_words(positive: list[str], negative: list[str], mine: Miner | None = None, rounds: int = 3, seed: int = 7) -> tuple[dict[int, float], float]:
    """Subsequence weights and offset of the machine on Nystrom features.

    After each round ``mine`` gives the clean words that the machine so far holds
    most toxic; they become negatives and landmarks of the next.
    """
    rng = np.random.default_rng(seed)
    hard: list[str] = []
    table: dict[int, float] = {}
    offset = 0.0
    for _ in range(rounds if mine else 1):
        words = [(v, 1.0) for i, w in enumerate(positive) for v in _variants(w, i)]
        words += [(v, -1.0) for i, w in enumerate(negative) for v in (_variants(w, i) if i % 4 == 0 else [w])]
        words += [(w, -1.0) for w in hard]
        marks = positive[: LANDMARKS * 4 // 9]
        marks = marks + hard[-LANDMARKS // 3 :]
        marks += [negative[i] for i in sorted(rng.permutation(len(negative))[: LANDMARKS - len(marks)])]
        land = [_profile(w) for w in marks]
        values, vectors = np.linalg.eigh(kernel(land, land))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        z = kernel([_profile(w) for w, _ in words], land) @ root
        z = np.column_stack([z, np.ones(len(z))])
        y = np.array([s for _, s in words])
        cost = np.where(y > 0, len(y) / (2.0 * (y > 0).sum()), len(y) / (2.0 * (y < 0).sum()))
        cost[len(y) - len(hard) :] *= 4.0
        w = _machine(z, y, cost)
        # Positives that look like clean words are there by chance; the second fit does without.
        keep = (y < 0) | (z @ w > 0)
        if (keep & (y > 0)).any():
            w = _machine(z[keep], y[keep], cost[keep])
        alpha = root @ w[:-1]
        table, offset = {}, float(w[-1])
        for a, (codes, values) in zip(alpha, land):
            for c, v in zip(codes.tolist(), (a * values).tolist()):
                table[c] = table.get(c, 0.0) + v
        if mine:
            hard += [w for w in mine(table, offset) if w not in hard]
    return table, offset


def fit_toxicity(docs: DataFrame, labels: DataFrame, documents: int = 6000, positives: int = 400, negatives: int = 9000, hard: int = 300) -> ToxicityModel:
    """The machine and its calibration from labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for mark in (0, 1):
        part = marks.filter(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id")).limit(documents)
        chosen = part if chosen is None else chosen.unionAll(part)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = slim.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    sentence_words = F.array_distinct(F.flatten(F.transform(F.split(F.lower("text"), r"[.!?\n]+"), lambda s: F.array_remove(F.split(s, r"[\x20\x09-\x0D]+"), ""))))
    counts = (
        known.dropDuplicates(["text"])
        .select("toxic", F.explode(sentence_words).alias("word"))
        .filter(F.length("word") <= LONGEST)
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    )
    counts = written(counts, "toxicity-words")
    # A word of one group of near copies is no evidence: it must come in SHARE of the toxic documents.
    toxic = known.filter("toxic = 1").dropDuplicates(["text"]).count()
    bad = counts.filter((F.col("t") >= max(3, SHARE * toxic)) & (F.col("n") * 20 <= F.col("t"))).orderBy(F.col("t").desc(), "word").limit(positives)
    clean_words = counts.filter("t <= n AND n > 0").select("word", "n")
    clean = clean_words
    usual = clean.orderBy(F.col("n").desc(), "word").limit(negatives // 3)
    clean = usual.unionAll(clean.orderBy(F.xxhash64("word")).limit(negatives - negatives // 3))
    positive = [r["word"] for r in bad.select("word").collect()]
    negative = [r["word"] for r in clean.select("word").collect()]
    if not positive or not negative:
        share = known.agg(F.sum("toxic"), F.count(F.lit(1))).first()
        base = np.log(((share[0] or 0) + 1.0) / (share[1] - (share[0] or 0) + 1.0))
        return ToxicityModel(*_hash_table({}), FLOOR, (0.0, 0.0, float(base)))
    def mine(weights: dict[int, float], offset: float) -> list[str]:
        model = ToxicityModel(*_hash_table(weights), offset, (0.0, 0.0, 0.0))
        scored = _worst(clean_words.withColumnRenamed("word", "text").withColumn("word", F.col("text")).select("word", "text"), model)
        return [r["word"] for r in scored.orderBy(F.col("worst").desc(), "word").limit(hard).collect()]

    weights, offset = train_words(positive, negative, mine)
    bare = ToxicityModel(*_hash_table(weights), offset, (0.0, 0.0, 0.0))
    rows = _worst(known, bare).select("worst", "second", "toxic").collect()
    values = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, 3)
    return ToxicityModel(bare.codes, bare.weights, offset, rising_fit(values[:, :2], values[:, 2]))


def rising_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A logistic curve without negative slopes: the best of the fits over some of the columns that has none.

    The loss is convex, so its least value under the bound is that of the free
    columns of some subset; two columns have four.
    """
    best: tuple[float, tuple[float, ...]] | None = None
    for chosen in range(1 << x.shape[1]):
        columns = [i for i in range(x.shape[1]) if chosen >> i & 1]
        fitted = logistic_fit(x[:, columns], y)
        if min(fitted[:-1], default=0.0) < 0:
            continue
        curve = np.zeros(x.shape[1] + 1)
        curve[columns], curve[-1] = fitted[:-1], fitted[-1]
        line = x @ curve[:-1] + curve[-1]
        loss = float((np.logaddexp(0, line) - y * line).sum())
        if best is None or loss < best[0]:
            best = loss, tuple(map(float, curve))
    return best[1]


_JUDGES: dict[int, Judge] = {}


def _judge(model: ToxicityModel) -> Judge:
    """One judge a worker and model, so that tasks share the words they know."""
    key = hash((model.codes.tobytes(), model.weights.tobytes(), model.offset))
    if key not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[key] = Judge(model)
    return _JUDGES[key]


def _worst(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows with column text replaced by worst and second."""
    names = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                values = judge.worst([t or "" for t in part.column("text").to_pylist()])
                columns = [*(part.column(c) for c in names), pa.array(values[:, 0]), pa.array(values[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "worst", "second"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "worst double, second double"]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, second, offset = map(F.lit, model.curve)
    line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), first * F.col("worst") + second * F.col("second") + offset))
    return _worst(slim, model).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
