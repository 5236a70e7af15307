"""Near duplicates by SimHash fingerprints at a small Hamming distance.

Candidates come from a generalised pigeonhole: the 64 bits are grouped into m
parts, correlated bits together; part i gets a threshold T_i >= -1 with
sum(T_i) = k - m + 1, so two fingerprints within k bits are within T_i in part
i for some i. m and the T_i are chosen by dynamic programming on estimated
numbers of keys and candidates; estimates change the cost, never the result.

Defined cases: null and empty texts have fingerprint zero and link like any
other. Repeated rows and ids are each returned. A component whose documents all
lack an id has a null component_id. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.llm.text import written

SEED = 42
BITS = 64
SAMPLE = 4096  # fingerprints used to estimate bit correlations and candidate counts
KEY_COST = 10.0  # one shuffled key costs as much as so many compared candidates
LARGE_BUCKET = 512  # above this a bucket is cut by a second pigeonhole
SLICE = 1 << 18  # edges that a task merges at once


def _set_bits(hashes: list[int]) -> int:
    """Bits that are one in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes))))


def simhash(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return _set_bits([digest(whole[a:b], SEED) for a, b in spans])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py() or b"", width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


# --- generalised pigeonhole -------------------------------------------------


def _bit_matrix(sample: np.ndarray) -> np.ndarray:
    return np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near-equal size; each takes the bits most correlated with those it has."""
    bits = _bit_matrix(sample)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1.0
    corr = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0.0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, parts))) // (m - i)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        part = [seed]
        left.discard(seed)
        while len(part) < size:
            best = max(sorted(left), key=lambda b: corr[b, part].mean())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def _within(sample: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated share of pairs within 0..most bits in a part: the larger of the sample's and of independent bits'."""
    mask = np.uint64(sum(1 << b for b in part))
    own = sample.view(np.uint64) & mask
    seen = np.zeros(most + 1)
    for i in range(0, len(own), 512):
        gaps = np.bitwise_count(own[i : i + 512, None] ^ own[None, :])
        seen += [(gaps <= t).sum() for t in range(most + 1)]
    pairs = max(1, len(own) * (len(own) - 1))
    p = _bit_matrix(sample)[:, part].mean(axis=0) if len(sample) else np.full(len(part), 0.5)
    law = np.zeros(len(part) + 1)
    law[0] = 1.0
    for q in 2 * p * (1 - p):
        law[1:] = law[1:] * (1 - q) + law[:-1] * q
        law[0] *= 1 - q
    model = np.cumsum(law)
    return [max((seen[t] - len(own)) / pairs, float(model[min(t, len(part))])) for t in range(most + 1)]


def allocate(sample: np.ndarray, n: int, k: int) -> list[tuple[list[int], int]]:
    """Parts and their thresholds (-1: never probed) with the least estimated cost for n fingerprints."""
    best_cost, best = float("inf"), []
    for m in range(1, k + 2):
        parts, total = correlated_parts(sample, m), k - m + 1
        costs = []
        for part in parts:
            share = _within(sample, part, max(total + m - 1, 0))
            keys, line = 0.0, {-1: 0.0}
            for t in range(min(total + m - 1, 2) + 1):  # a ball of radius 3 in a part is never worth its keys
                keys += float(np.prod([(len(part) - j) / (j + 1) for j in range(t)])) if t else 1.0
                line[t] = KEY_COST * n * (keys + (t > 0)) + n * n / 2 * share[t]
            costs.append(line)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for line in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t, c in line.items():
                    if used + t not in step or cost + c < step[used + t][0]:
                        step[used + t] = (cost + c, [*chosen, t])
            table = step
        if total in table and table[total][0] < best_cost:
            best_cost, best = table[total][0], list(zip(parts, table[total][1]))
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(part: list[int]) -> int:
    return _signed(sum(1 << b for b in part))


def _flips(part: list[int], radius: int) -> list[int]:
    """Every set of 1..radius bits of the part as a mask."""
    out = [1 << b for b in part] if radius >= 1 else []
    if radius >= 2:
        out += [(1 << a) | (1 << b) for i, a in enumerate(part) for b in part[i + 1 :]]
    return [_signed(x) for x in out]


def hamming_links(distinct: DataFrame, k: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """Pairs a < b of the fingerprints in column fp that differ in 1..k bits.

    A pair may come more than once. Buckets of over ``large`` fingerprints are
    probed again by the k + 1 parts of the remaining bits, one of which agrees.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    every = max(1, n // SAMPLE)
    rows = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * SAMPLE).collect()
    sample = np.array([r[0] for r in rows] or [0], dtype=np.int64)
    plan = allocate(sample, n, k)

    keys = None
    for i, (part, t) in enumerate(plan):
        if t < 0:
            continue
        mask = F.lit(_mask(part))
        own = distinct.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).alias("key"), "fp", F.lit(False).alias("probe"))
        keys = own if keys is None else keys.unionAll(own)
        if t > 0:
            flips = F.explode(F.array(*[F.lit(x) for x in _flips(part, t)])).alias("flip")
            near = distinct.select("fp", flips)
            keys = keys.unionAll(
                near.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).bitwiseXOR(F.col("flip")).alias("key"), "fp", F.lit(True).alias("probe"))
            )
    keys = written(keys, "simhash-keys")
    big = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > large)
    big = written(big, "simhash-large")

    def verify(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        same = F.lit(True)
        for c in on:
            same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= k
        # Among own keys each pair once; a probing key meets own keys only.
        order = F.col("x.probe") | (F.col("x.fp") < F.col("y.fp"))
        found = x.join(y, same & near & order & (F.col("x.fp") != F.col("y.fp")))
        return found.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))

    if big.isEmpty():
        return verify(keys, keys.filter(~F.col("probe")), ["part", "key"])
    small = keys.join(big, ["part", "key"], "left_anti")
    out = verify(small, small.filter(~F.col("probe")), ["part", "key"])
    # Bits outside each part, dealt to k + 1 groups: one of them agrees exactly.
    cases = []
    for i, (part, t) in enumerate(plan):
        rest = [b for b in range(BITS) if b not in part]
        groups = [rest[j :: k + 1] for j in range(k + 1)]
        cases.append((i, F.array(*[F.struct(F.lit(j).alias("sub"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("rest")) for j, g in enumerate(groups)])))
    pick = None
    for i, value in cases:
        pick = F.when(F.col("part") == i, value) if pick is None else pick.when(F.col("part") == i, value)
    fine = keys.join(big, ["part", "key"]).select("part", "key", "fp", "probe", F.inline(pick))
    on = ["part", "key", "sub", "rest"]
    return out.unionAll(verify(fine, fine.filter(~F.col("probe")), on))


# --- components -------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges root, node with the components of the edges a, b: one for each node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[own]], nodes[own]


def merged(edges: DataFrame) -> DataFrame:
    """Fewer edges a < b with the same components: each slice of SLICE edges that lie together becomes a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = forest(*np.concatenate(held, axis=1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
            size += batch.num_rows
            if size >= SLICE:
                yield out()
                size = 0
        if size:
            yield out()

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node of the edges a, b.

    Alternating large and small stars. The edges that lie in one task are merged
    to a forest in front of the small star's shuffle, so a hub has one row a slice
    there. Each round is written to the shared folder; stops when every edge leads
    from a root to a node without another.
    """

    def settled(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(0).alias("child")).unionAll(df.select("b", F.lit(1)))
        per = ends.groupBy("node").agg(F.sum("child").alias("above"), F.count(F.lit(1)).alias("all"))
        return per.agg(F.count_if((F.col("above") > 1) | ((F.col("above") == 1) & (F.col("all") > 1)))).first()[0] == 0

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that Spark can split a hub's rows in the join that follows.
        low = written(both.groupBy("a").agg(F.min("b").alias("low")), "edges-low")
        return df.join(low, "a").select(F.least("a", "low").alias("a"), "b")

    def small_star(df: DataFrame) -> DataFrame:
        near = df.groupBy("b").agg(F.collect_set("a").alias("near"))
        out = near.select(F.array_min("near").alias("a"), F.explode(F.array_append("near", F.col("b"))).alias("b"))
        return out.filter("a < b")

    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = written(merged(edges), "edges")
    for _ in range(most_rounds):
        if settled(edges):
            break
        edges = written(small_star(merged(large_star(edges))), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp, root (a fingerprint naming the component), component_id (its smallest doc_id) per row of docs."""
    fps = written(fingerprints(docs, width), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    least = written(least, "classes")
    edges = hamming_links(least.select("fp"), k)
    roots = components(edges)
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    # Tables of one row a component or class, written: Spark splits the hot keys of the other side.
    named = written(named, "roots")
    low = written(named.groupBy("root").agg(F.min("doc").alias("component_id")), "components")
    classes = written(named.join(low, "root").select("fp", "root", "component_id"), "members")
    return fps.join(classes, "fp")


def keep_named(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of docs that a component_id names; of repeated rows with one id and text one, and every row without id."""
    best = components.select(F.col("component_id").alias("_best")).filter("_best IS NOT NULL").distinct()
    named = docs.join(best, F.col("doc_id").cast("bigint") == F.col("_best"), "left_semi")
    named = named.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return named.unionAll(docs.filter(F.col("doc_id").isNull()))


def keep_representatives(docs: DataFrame, k: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component.

    Of repeated rows with one id and text one stays. A row without id cannot be
    named and always stays.
    """
    return keep_named(docs, near_duplicates(docs, k, width))
