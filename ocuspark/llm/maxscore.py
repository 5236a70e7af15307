"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Documents are dealt to shards by a hash; a shard's documents are numbered by
ascending id. Its index holds, for every term, postings in blocks of BLOCK
documents: the last document and the largest impact of each block stand beside
the packed postings. An impact is the part of a score that a term's weight is
multiplied with, from corpus-wide counts, so shards score alike.

A query walks a shard in windows of ascending documents. Its terms are ordered
by their greatest possible share of a score. Those whose shares together cannot
beat the k-th best score so far are non-essential: only documents in the other,
essential lists can still get in. A window's essential postings give the
candidates with partial scores (none at all if block maxima already rule the
window out); then the non-essential lists, greatest first, look at the
candidate's block maximum and reject it before the block is unpacked if even
that cannot help. The k-th best score rises as windows pass, and terms turn
non-essential. The k best of every shard meet in one window per query. Pruning
only drops what cannot enter, so the result is exact.

Scores are whole numbers. Equal scores rank by ascending doc_id, null last; as
documents are walked in that order, a later one needs a greater score.

Defined cases: null texts and texts without terms are found by no query and do
not count as documents; items without known terms have no rows; items that
share id and text ask once; rows that share an id are documents of their own; a
document without id can be found. Very long texts are indexed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.llm.text import written
from ocuspark.operators.skew import split_join

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 128
WINDOW = 1024  # documents looked at together
SHARD_DOCS = 16_384
SHARD_POSTINGS = 1_000_000  # a task sorts these: about 150 MB
BATCH_TERMS = 200_000  # query terms that meet a shard in one task
POSTING = np.dtype([("gap", "<u2"), ("impact", "<u4")])
INDEX = "shard int, term string, df bigint, last array<int>, top array<int>, blocks array<binary>, ids array<bigint>"
UPPER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other code points above 0x7F; A-Z lower-cased."""
    return TERM.findall(text.lower())


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, deal (a hash of the row), n (terms with repeats), terms and tfs of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [Counter(terms_of(t.encode())) for t in part.column("text").to_pylist()]
                keep = [i for i, bag in enumerate(found) if bag]
                columns = [
                    part.column("doc_id").take(pa.array(keep, pa.int64())), part.column("deal").take(pa.array(keep, pa.int64())),
                    pa.array([found[i].total() for i in keep], pa.int64()),
                    pa.array([list(found[i]) for i in keep], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array([list(found[i].values()) for i in keep], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "deal", "n", "terms", "tfs"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = slim.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("deal"), "text")
    return dealt.mapInArrow(run, "doc_id bigint, deal bigint, n bigint, terms array<string>, tfs array<int>")


def _index_shard(n_docs: int, n_terms: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").combine_chunks()
        order = pa.compute.sort_indices(table.select(["doc_id", "deal"]), sort_keys=[("doc_id", "ascending"), ("deal", "ascending")], null_placement="at_end")
        place = np.empty(len(ids), np.int64)
        place[np.asarray(order)] = np.arange(len(ids))
        terms = table.column("terms").combine_chunks()
        lengths = np.diff(np.asarray(terms.offsets))
        coded = terms.flatten().dictionary_encode()
        code, tf = np.asarray(coded.indices).astype(np.int64), np.asarray(table.column("tfs").combine_chunks().flatten()).astype(np.int64)
        m = 75 + (25 * np.asarray(table.column("n")) * n_docs) // n_terms
        doc = np.repeat(place, lengths)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, lengths))
        by = np.lexsort((doc, code))
        doc, code, impact = doc[by], code[by], impact[by]
        first = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
        df = np.diff(first)
        nth = np.arange(len(doc)) - np.repeat(first[:-1], df)
        start = np.flatnonzero(nth % BLOCK == 0)  # of blocks
        end = np.append(start[1:], len(doc))
        postings = np.zeros(len(doc), POSTING)
        postings["gap"][1:] = np.where(nth[1:] % BLOCK == 0, doc[1:], np.diff(doc))
        postings["gap"][:1] = doc[:1]
        postings["impact"] = impact
        bounds = pa.array(np.append(start, len(doc)) * POSTING.itemsize, pa.int32())
        blocks = pa.Array.from_buffers(pa.binary(), len(start), [None, bounds.buffers()[1], pa.py_buffer(postings.tobytes())])
        per_term = pa.array(np.append(0, np.cumsum(-(-df // BLOCK))), pa.int32())

        def lists(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(per_term, values)

        n = len(df)
        shard = table.column("shard")[0].as_py()
        rows = pa.table(
            {
                "shard": pa.array([shard] * n, pa.int32()),
                "term": coded.dictionary,
                "df": pa.array(df, pa.int64()),
                "last": lists(pa.array(doc[end - 1], pa.int32())),
                "top": lists(pa.array(np.maximum.reduceat(impact, start), pa.int32())),
                "blocks": lists(blocks),
                "ids": pa.nulls(n, pa.list_(pa.int64())),
            }
        )
        # The shard's directory: ids by place, beside the empty term that no text holds.
        own = pa.table(
            {
                "shard": pa.array([shard], pa.int32()), "term": [""], "df": pa.array([0], pa.int64()), "last": pa.nulls(1, pa.list_(pa.int32())),
                "top": pa.nulls(1, pa.list_(pa.int32())), "blocks": pa.nulls(1, pa.list_(pa.binary())), "ids": pa.array([ids.take(order)], pa.list_(pa.int64())),
            }
        )
        return pa.concat_tables([rows, own])

    return run


class Index:
    """A written index: rows (table), number of documents and of terms with repeats."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """Index of docs (doc_id, text). A shard has about shard_docs documents (2 ** 16 at most) and shard_postings postings."""
    found = written(bags(docs), "maxscore-bags")
    n_docs, n_terms, postings = found.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("tfs"))).first()
    shards = max(1, -(-n_docs // min(shard_docs, 1 << 15)), -(-(postings or 0) // shard_postings))
    dealt = found.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    rows = dealt.groupBy("shard").applyInArrow(_index_shard(n_docs, n_terms or 1), INDEX)
    return Index(written(rows, "maxscore-index"), n_docs, n_terms or 0)


class Postings:
    """One term's list in one shard; blocks are unpacked when asked for, and counted."""

    def __init__(self, last: np.ndarray, top: np.ndarray, blocks: pa.Array):
        self.last, self.top, self.blocks = last.astype(np.int64), top.astype(np.int64), blocks
        self.most = int(self.top.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if i not in self.open:
            packed = np.frombuffer(self.blocks[i].as_py(), POSTING)
            self.open[i] = np.cumsum(packed["gap"], dtype=np.int64), packed["impact"].astype(np.int64)
        return self.open[i]

    def over(self, low: int, high: int) -> range:
        """Blocks that may hold documents of [low, high)."""
        a, b = np.searchsorted(self.last, [low, high - 1])
        return range(int(a), min(int(b) + 1, len(self.last)))


def best_of_shard(lists: list[Postings], weights: list[int], n_docs: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents, best first."""
    order = sorted((i for i in range(len(lists)) if weights[i] > 0), key=lambda i: lists[i].most * weights[i])
    lists, weights = [lists[i] for i in order], [weights[i] for i in order]
    share = np.array([p.most * w for p, w in zip(lists, weights)], np.int64)
    upto = np.append(0, np.cumsum(share))  # bound of the first i lists together
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold = 0
    for low in range(0, n_docs, window):
        high = min(low + window, n_docs)
        first = int(np.searchsorted(upto[1:], threshold, side="right"))  # essential from here
        if first == len(lists):
            break
        spans = [p.over(low, high) for p in lists[first:]]
        tops = [int(p.top[s.start : s.stop].max()) * w if len(s) else 0 for p, s, w in zip(lists[first:], spans, weights[first:])]
        if sum(tops) + int(upto[first]) <= threshold:
            continue
        partial = np.zeros(high - low, np.int64)
        for p, span, w in zip(lists[first:], spans, weights[first:]):
            for i in span:
                doc, impact = p.block(i)
                a, b = np.searchsorted(doc, [low, high])
                partial[doc[a:b] - low] += w * impact[a:b]
        at = np.flatnonzero(partial + upto[first] > threshold)
        at = at[partial[at] > 0]
        sums = partial[at]
        at = at + low
        for j in range(first - 1, -1, -1):
            if not len(at):
                break
            p, w = lists[j], weights[j]
            where = np.searchsorted(p.last, at)
            inside = where < len(p.last)
            bound = np.where(inside, p.top[np.minimum(where, len(p.last) - 1)], 0) * w
            keep = sums + bound + upto[j] > threshold
            at, sums, where = at[keep], sums[keep], where[keep]
            for i in np.unique(where[where < len(p.last)]).tolist():
                doc, impact = p.block(i)
                own = np.flatnonzero(where == i)
                hit = np.minimum(np.searchsorted(doc, at[own]), len(doc) - 1)
                sums[own] += np.where(doc[hit] == at[own], impact[hit], 0) * w
        good = sums > threshold
        docs, scores = np.append(docs, at[good]), np.append(scores, sums[good])
        if len(docs) > k:
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
        if len(docs) == k:
            threshold = int(scores.min())
    best = np.lexsort((docs, -scores))
    return docs[best], scores[best]


def _search_shard(k: int):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("term").to_pylist()
        n_docs, ids, lists = 0, None, {}
        asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, name in enumerate(names):
            if name == "":
                ids = table.column("ids")[i].values
                n_docs = len(ids)
                continue
            last, top, blocks = (table.column(c)[i].values for c in ("last", "top", "blocks"))
            lists[i] = Postings(np.asarray(last), np.asarray(top), blocks)
            w = table.column("w")[i].as_py()
            items = table.column("items")[i].values
            for item, key, count in zip(*(items.field(c).to_pylist() for c in ("item_id", "item_key", "count"))):
                asked.setdefault((item, key), []).append((i, w * count))
        out: dict[str, list] = {"item_id": [], "item_key": [], "doc_id": [], "score": []}
        for (item, key), own in asked.items():
            docs, scores = best_of_shard([lists[i] for i, _ in own], [w for _, w in own], n_docs, k)
            out["item_id"] += [item] * len(docs)
            out["item_key"] += [key] * len(docs)
            out["doc_id"] += ids.take(pa.array(docs)).to_pylist()
            out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, item_key, term and count of the terms of every item (item_id, text)."""
    slim = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lower = F.translate("text", *UPPER)
    terms = F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    once = slim.select("item_id", F.xxhash64("text").alias("item_key"), terms.alias("terms")).dropDuplicates(["item_id", "item_key"])
    return once.select("item_id", "item_key", F.explode("terms").alias("term")).groupBy("item_id", "item_key", "term").agg(F.count(F.lit(1)).alias("count"))


def search(index: Index, items: DataFrame, k: int = 20, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item."""
    terms = written(query_terms(items), "maxscore-query-terms")
    batches = max(1, -(-terms.count() // batch_terms))
    batch = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(batches)).cast("int")
    # Within a batch a term has at most as many items as the batch.
    grouped = terms.groupBy(batch.alias("batch"), "term").agg(F.collect_list(F.struct("item_id", "item_key", "count")).alias("items"))
    postings = index.rows.filter("term != ''")
    df = postings.groupBy("term").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("n")).join(terms.select("term").distinct(), "term", "left_semi")
    df = written(df, "maxscore-frequencies")
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("bigint")
    asked = grouped.join(df, "term").select("batch", "term", weight.alias("w"), "items")
    # A frequent term has a row in every shard: its key is split.
    rows = split_join(postings, asked, ["term"], spread=["shard"], counts=df.select("term", "n"))
    columns = ["shard", "batch", "term", "w", "items", "last", "top", "blocks", "ids"]
    of_shards = index.rows.filter("term = ''").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    of_shards = of_shards.withColumn("w", F.lit(None).cast("bigint")).withColumn("items", F.lit(None).cast(asked.schema["items"].dataType))
    rows = rows.select(*columns).unionAll(of_shards.select(*columns))
    found = rows.groupBy("shard", "batch").applyInArrow(_search_shard(k), "item_id bigint, item_key bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id", "item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
