"""Exact top-k search: BM25 over sharded inverted indexes with block-max pruning.

Documents are dealt to shards of about ``shard_docs`` by a hash of their id.
Document frequencies, document count and mean length are taken over all
documents, so a score does not depend on the shard. Each shard builds an
inverted index of the terms that queries use, in blocks of BLOCK documents with
the largest impact of each term in each block. A query adds these maxima to an
upper bound per block, scores the most promising blocks to get a threshold, then
only the blocks whose bound reaches it; the rest cannot hold a result. The k best
of every shard are merged by a window per query. Nothing is approximate.

Where the first queries show that most blocks are scored anyway (whole texts as
queries, documents in no order), block maxima cost more than they save. Then the
terms that every DENSE-th document holds, which have most postings, become rows
of a matrix, and a group of queries gets their sums as one product; the other
terms are added by their postings, and what lies below the k best so far is left.

Impacts are whole numbers (BM25 times SCALE, rounded per term), so that sums and
ties do not depend on the order of addition; ties go to the smaller doc_id.

A query is the set of distinct words of its text. Defined cases: null and empty
texts are found by no query and find nothing; a document without id can be
found (last among ties) but asks nothing; rows that share id and text ask once
and are found each; fewer than k matches give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.llm.text import U64, slices, span_hashes, utf8, word_spans, written

K1, B = 0.9, 0.4
SCALE = 1 << 20
BLOCK = 128
SHARD_DOCS = 16_384
BATCH_TERMS = 2_500_000  # terms of the queries that meet a shard in one task: 40 MB
SLICE_WORDS = 1 << 20  # words of a shard's documents that are indexed at a time
FIRST_BLOCKS = 4  # scored before anything is pruned
DENSE = 16  # a term of every so many documents of a slice is a row of its matrix
GROUP = 64  # queries of a product, and of the trial of block maxima
NO_ID = (1 << 62) - 1


def _bags(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, term and count of the distinct words of every row, and the rows' lengths in words."""
    starts, ends, first = word_spans(body, offsets)
    lengths = np.diff(first)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = span_hashes(body, starts, ends)
    # By term, then by row with a sort that keeps that order; few rows fit 16 bits, which sort faster.
    order = np.argsort(term)
    order = order[np.argsort(row[order].astype(np.uint16 if len(lengths) <= 1 << 16 else row.dtype), kind="stable")]
    row, term = row[order], term[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(np.append(at, len(term))), lengths


def _pieces(column: pa.Array) -> Iterator[tuple[int, tuple]]:
    body, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, _bags(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _frequencies(docs: DataFrame) -> DataFrame:
    """term and df over all documents; a batch adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag[1] for _, bag in _pieces(batch.column("text"))]
            if found:
                term, df = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _query_terms(queries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, (row, term, _, _) in _pieces(batch.column("text")):
                own = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(own), batch.column("query_key").take(own), pa.array(term.view(np.int64))], ["query_id", "query_key", "term"]
                )

    return queries.mapInArrow(run, "query_id bigint, query_key bigint, term bigint")


def _packed_queries(terms: DataFrame) -> DataFrame:
    """A row per query: its terms and their document frequencies as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for pairs in batch.column("pairs"):
                values = pairs.values
                term, df = np.asarray(values.field("term")), np.asarray(values.field("df"))
                packed.append(np.concatenate([term.astype("<i8").view(np.uint8), df.astype("<i8").view(np.uint8)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query_key"), pa.array(packed, pa.binary())], ["query_id", "query_key", "packed"])

    # As many pairs as the query has distinct words.
    rows = terms.groupBy("query_id", "query_key").agg(F.collect_list(F.struct("term", "df")).alias("pairs"))
    return rows.mapInArrow(run, "query_id bigint, query_key bigint, packed binary")


class Shard:
    """Inverted index of one shard over the terms that queries use."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray, df: np.ndarray, n: int, mean: float):
        self.ids, self.n_docs = ids, len(ids)
        self.vocabulary = vocabulary
        tf = counts.astype(np.float64)
        norm = K1 * (1 - B + B * lengths[rows] / mean)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = np.rint(SCALE * idf[terms] * tf * (K1 + 1) / (tf + norm))
        order = np.lexsort((rows, terms))
        self.rows, self.impact, terms = rows[order].astype(np.int64), impact[order], terms[order]
        self.first = np.searchsorted(terms, np.arange(len(vocabulary) + 1))
        self.n_blocks = -(-self.n_docs // BLOCK)
        cell = terms * self.n_blocks + self.rows // BLOCK
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.cell_block = cell[at] % self.n_blocks if len(at) else at
        self.cell_max = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.cell_start, self.cell_end = at, np.append(at[1:], len(cell))
        self.first_cell = np.searchsorted(cell[at] // max(1, self.n_blocks), np.arange(len(vocabulary) + 1)) if len(at) else np.zeros(len(vocabulary) + 1, np.int64)
        self.scored_blocks = self.all_blocks = 0
        self.row_of: np.ndarray | None = None

    @staticmethod
    def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All positions of the given ranges, one after the other."""
        sizes = ends - starts
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def top(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) and scores of the k best, best first."""
        cells = self._spread(self.first_cell[terms], self.first_cell[terms + 1])
        bound = np.bincount(self.cell_block[cells], weights=self.cell_max[cells], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        self.all_blocks += len(order)
        scores = np.zeros(self.n_docs)
        done = 0
        threshold = 0.0
        while done < len(order) and bound[order[done]] > 0 and bound[order[done]] >= threshold:
            size = FIRST_BLOCKS if done == 0 else int((bound[order[done:]] >= max(threshold, 1.0)).sum())
            chosen = order[done : done + size]
            take = np.zeros(self.n_blocks, dtype=bool)
            take[chosen] = True
            part = cells[take[self.cell_block[cells]]]
            at = self._spread(self.cell_start[part], self.cell_end[part])
            scores += np.bincount(self.rows[at], weights=self.impact[at], minlength=self.n_docs)
            done += size
            if self.n_docs > k:
                threshold = np.partition(scores, self.n_docs - k)[self.n_docs - k]
        self.scored_blocks += done
        return self._best(scores, threshold, k)

    def _best(self, scores: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero((scores >= threshold) & (scores > 0))
        found = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return found, scores[found]

    def top_of_group(self, asked: list[np.ndarray], floors: list[float], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``top`` of every query without block maxima; documents below a query's floor may be left out.

        Impacts are whole numbers, so the product is exact in any order of addition.
        """
        if self.row_of is None:
            sizes = np.diff(self.first)
            frequent = np.flatnonzero(sizes * DENSE >= max(1, self.n_docs))
            self.row_of = np.full(len(sizes), -1)
            self.row_of[frequent] = np.arange(len(frequent))
            self.matrix = np.zeros((len(frequent), self.n_docs))
            for row, term in enumerate(frequent):
                at = slice(self.first[term], self.first[term + 1])
                self.matrix[row, self.rows[at]] = self.impact[at]
        has = np.zeros((len(asked), len(self.matrix)))
        for q, terms in enumerate(asked):
            own = self.row_of[terms]
            has[q, own[own >= 0]] = 1
        for sums, terms, floor in zip(has @ self.matrix, asked, floors):
            rest = terms[self.row_of[terms] < 0]
            at = self._spread(self.first[rest], self.first[rest + 1])
            scores = sums + np.bincount(self.rows[at], weights=self.impact[at], minlength=self.n_docs)
            if not floor and self.n_docs > k:
                floor = np.partition(scores, self.n_docs - k)[self.n_docs - k]
            yield self._best(scores, floor, k)


def _slices_of(docs: pa.Table, vocabulary: np.ndarray, df: np.ndarray, n: int, mean: float) -> Iterator[Shard]:
    """Indexes of the documents of a shard, about SLICE_WORDS words each: a task holds one at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.asarray(docs.column("doc_id").combine_chunks().fill_null(NO_ID))
    first = held = 0
    parts: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, docs.num_rows, 256):
        packed = docs.column("packed").slice(begin, 256).to_pylist()
        for a, (row, term, count, length) in _pieces(pa.array([unpack(t) for t in packed], pa.large_binary())):
            place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            known = vocabulary[place] == term
            parts.append((begin + a - first + row[known], place[known], count[known], length))
            held += int(length.sum())
        end = begin + len(packed)
        if held >= SLICE_WORDS or end == docs.num_rows:
            yield Shard(ids[first:end], *map(np.concatenate, zip(*parts)), vocabulary, df, n, mean)
            first, held, parts = end, 0, []


def _search_shard(k: int, n: int, mean: float):
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "query_key": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not docs.num_rows or not queries.num_rows:
            return empty
        asked = [np.frombuffer(p, dtype="<i8").reshape(2, -1) for p in queries.column("packed").to_pylist()]
        pairs = np.concatenate(asked, axis=1)
        vocabulary, at = np.unique(pairs[0].view(U64), return_index=True)
        df = pairs[1][at].astype(np.float64)
        places = [np.searchsorted(vocabulary, own[0].view(U64)) for own in asked]
        # The k best of the slices before, per query.
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        for shard in _slices_of(docs, vocabulary, df, n, mean):
            for begin in range(0, len(places), GROUP):
                group = range(begin, min(begin + GROUP, len(places)))
                if 2 * shard.scored_blocks > shard.all_blocks:
                    floors = [best[q][1][-1] if len(best[q][1]) == k else 0.0 for q in group]
                    tops = shard.top_of_group([places[q] for q in group], floors, k)
                else:
                    tops = (shard.top(places[q], k) for q in group)
                for q, (found, scores) in zip(group, tops):
                    if not len(found):
                        continue
                    ids, scores = np.append(best[q][0], shard.ids[found]), np.append(best[q][1], scores)
                    first = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[first], scores[first]
        counts = [len(ids) for ids, _ in best]
        asked_by = [np.repeat(queries.column(c).to_numpy(), counts) for c in ("query_id", "query_key")]
        ids, scores = (np.concatenate([b[i] for b in best]).astype(np.int64) for i in (0, 1))
        return pa.table(dict(zip(empty.column_names, (*asked_by, ids, scores))), schema=empty.schema)

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score (BM25) of the k best documents of every query (query_id, text)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = asked.filter("query_id IS NOT NULL").withColumn("query_key", F.xxhash64("text")).select("query_id", "query_key", "text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    n, total = slim.agg(F.count(F.lit(1)), F.sum(words)).first()
    shards = max(1, -(-n // shard_docs))
    terms = _query_terms(asked).distinct().join(_frequencies(slim), "term")
    packed = written(_packed_queries(terms), "search-queries")
    batches = max(1, -(-(packed.agg(F.sum(F.length("packed"))).first()[0] or 0) // (16 * batch_terms)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([squeeze(t.as_py()) for t in batch.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), texts], ["doc_id", "shard", "packed"])

    shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(shards)).cast("int")
    dealt = slim.select("doc_id", shard.alias("shard"), "text").mapInArrow(pack, "doc_id bigint, shard int, packed binary")
    # Every shard meets every batch of queries, each pair in a task of its own.
    shard_batches = dealt.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    batch = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(batches)).cast("int")
    everywhere = packed.withColumn("batch", batch).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = shard_batches.groupBy("shard", "batch").cogroup(everywhere.groupBy("shard", "batch")).applyInArrow(
        _search_shard(k, n, max((total or 0) / max(n, 1), 1e-9)), "query_id bigint, query_key bigint, doc_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("score") / SCALE).alias("score"))


def brute_force(docs: list[tuple[int, str]], queries: list[tuple[int, str]], k: int = 10) -> list[tuple[int, int, int, float]]:
    """The same by scoring every document against every query. For tests."""
    import math
    from collections import Counter

    bags = [(i, Counter((t or "").encode().split())) for i, t in docs]
    df = Counter(w for _, bag in bags for w in bag)
    n, mean = len(bags), max(sum(sum(b.values()) for _, b in bags) / max(len(bags), 1), 1e-9)
    out = []
    for q, text in queries:
        scored = []
        for i, bag in bags:
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            s = sum(round(SCALE * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (K1 + 1) / (bag[w] + norm)) for w in set((text or "").encode().split()) if w in bag)
            if s > 0:
                scored.append((-s, i))
        out += [(q, r + 1, i, -s / SCALE) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out
