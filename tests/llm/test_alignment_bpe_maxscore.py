"""Segment-tree merges, tokenizer alignment and MaxScore search beside the public libraries, brute force and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ocuspark.llm import aligning, bpe, maxscore, queries
from ocuspark.llm.text import table

from .conftest import ODD

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def merges(spark):
    return bpe.default_merges(spark)


@pytest.fixture(scope="module")
def pieces(spark):
    return aligning.default_pieces(spark)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Byte-pair encoding


def test_bpe_query_equals_the_library_on_whole_tables(spark, library):
    for folder in (TINY, SMALL):
        rows = {r["doc_id"]: r for r in queries.op12_segment_tree_bpe(spark, folder).collect()}
        docs = table(spark, folder, "documents").select("doc_id", "text").collect()
        assert len(rows) == len(docs)
        for d in docs:
            ids = library.encode(d["text"] or "", add_special_tokens=False).ids
            r = rows[d["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
                len(ids),
                sha(",".join(map(str, ids))),
                sha(library.decode(ids, skip_special_tokens=False)),
            )


def test_bpe_code_points_and_special_strings(merges, library):
    coder = bpe.Encoder(merges)
    step = 0x1000
    for low in range(0, 0x110000, step):
        texts = [f"a{chr(c)}7{chr(c)}! {chr(c)}{chr(c)} 's{chr(c)}" for c in range(low, low + step, 7) if not 0xD800 <= c < 0xE000]
        assert [x.tolist() for x in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    special = ["<|endoftext|>", "x <|endoftext|>  <|endoftext|>\n\n y", "<|endoftext|", "a  <|endoftext|>b   "]
    assert [x.tolist() for x in coder.encode(special)] == [e.ids for e in library.encode_batch(special, add_special_tokens=False)]
    plain = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert [x.tolist() for x in coder.encode(special, special=False)] == [e.ids for e in plain.encode_batch(special, add_special_tokens=False)]


def test_bpe_tree_is_the_leftmost_lowest_rank_rule(merges):
    """Both trees beside a scan of all pairs for the lowest rank, leftmost first, at each step."""
    coder, r = bpe.Encoder(merges), random.Random(5)
    words = ["".join(r.choice("aabehilnorst ") for _ in range(r.randint(1, 90))).encode() for _ in range(150)] + [b"a" * 200, b"ab" * 100]

    def scan(word):
        own = [merges.first[b] for b in word]
        while True:
            ranks = [(coder.rank_of.get(x * coder.size + y, math.inf), i) for i, (x, y) in enumerate(zip(own, own[1:]))]
            if not ranks or min(ranks)[0] == math.inf:
                return own
            rank, i = min(ranks)
            own[i : i + 2] = [int(merges.made[rank])]

    want = [scan(w) for w in words]
    assert [np.frombuffer(x, bpe.ID).tolist() for x in coder.merge_many(words)] == want
    assert [np.frombuffer(coder.merge_one(w), bpe.ID).tolist() for w in words] == want


def test_bpe_long_words_and_small_cache(merges, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 20)
    coder = bpe.Encoder(merges)
    texts = ["字汉" * 60_000, "a" * 100_000, "é" * 3000 + " end", " \n" * 40_000, "", "one two three"] * 2
    got = [coder.encode([t])[0] for t in texts]
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.decode(x) for x in got] == texts


def test_bpe_odd_rows(spark, odd, none, merges):
    coded = bpe.encode(odd, merges)
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(coded, merges).collect())
    assert back == Counter((i, t) for i, t, *_ in ODD)
    rows = bpe.round_trip(odd, merges).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == Counter((i, sha(t or "")) for i, t, *_ in ODD)
    assert bpe.encode(none, merges).count() == bpe.round_trip(none, merges).count() == 0
    bad = spark.createDataFrame([(1, [255, 200]), (2, None), (3, [])], "doc_id bigint, tokens array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bad, merges).collect()}[2] is None


# Alignment


def brute_alignment(texts):
    """Per (id, text): measures, from the public libraries, every document on its own."""
    import sentencepiece

    a = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    letters = bpe.byte_letters()
    rows, links = [], Counter()
    for _, text in texts:
        coded = a.encode(" " + text, add_special_tokens=False) if text else None
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in coded.ids] if text else []
        two = []
        for i in b.encode(text) if text else []:
            p = b.id_to_piece(i)
            two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        if text and not (b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode()):
            one, two = [], []
        ends = []
        for side in (one, two):
            at = 0
            ends.append({})
            for i, x in side:
                at += len(x)
                ends[-1][at] = i
        shared = sorted(ends[0].keys() & ends[1].keys())
        own = [(ends[0][e], ends[1][e]) for e in shared]
        groups, low = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for at, i in side.items() if low < at <= e) for side in ends))
            low = e
        rows.append((len(one), len(two), len(groups), own, ";".join(groups)))
        links.update(own)
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    out = Counter()
    for (doc, _), (n_a, n_b, n_groups, own, groups) in zip(texts, rows):
        best = sum(links[x] == most[x[1]] for x in own)
        out[(doc, n_a, n_b, n_groups, len(own), best, sum(links[x] for x in own), sha(groups) if groups else "")] += 1
    return out, links


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, TINY, "documents").collect()]
    want, _ = brute_alignment(docs)
    got = queries.op11_cross_tokenizer_alignment(spark, TINY)
    assert got.columns == list(FIELDS) and dict(got.dtypes)["count_sum"] == "bigint"
    assert Counter(tuple(r) for r in got.collect()) == want


def test_alignment_of_odd_rows_copies_and_pairs(spark, odd, none, merges, pieces):
    texts = [(i, t) for i, t, *_ in ODD]
    want, links = brute_alignment(texts)
    found = aligning.align(odd, merges, pieces)
    assert Counter(tuple(r) for r in found.measures().select(*FIELDS).collect()) == want
    assert {(r["a"], r["b"]): r["links"] for r in found.pairs.collect()} == dict(links)
    assert found.texts.count() == len({t for _, t in texts if t})
    assert aligning.align(none, merges, pieces).measures().count() == 0
    # A third of all rows hold one text; strings of special tokens are plain text.
    rows = [(i, "same old <|endoftext|> story </s>" if i % 3 == 0 else f"<s> text number {i % 40} zähl") for i in range(300)]
    want, _ = brute_alignment(rows)
    found = aligning.align(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), merges, pieces)
    assert Counter(tuple(r) for r in found.measures().collect()) == want


# MaxScore


def brute_search(docs, items, k=20):
    bags = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for item, text in items:
        terms = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        scored = []
        for i, bag in bags:
            m = 75 + (25 * bag.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m)) for w in terms if w in bag)
            if s > 0:
                scored.append((-s, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def rows_of(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = set(con.execute(queries.CHECKS["op13_block_max_maxscore"]).fetchall())
    assert rows_of(queries.op13_block_max_maxscore(spark, SMALL)) == want


def test_search_shards_batches_and_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    items = table(spark, SMALL, "benchmark").select("item_id", "text")
    want = brute_search([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    index = maxscore.build_index(docs, shard_docs=300)
    assert index.rows.select("shard").distinct().count() == 4
    assert rows_of(maxscore.search(index, items)) == want
    assert rows_of(maxscore.search(index, items, batch_terms=200)) == want


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "Tale1 tale2, TALE3 tale3"), (1, "zwölf nicode"), (2, None), (3, ""), (4, "unknown"), (None, "one TWO two"), (None, "one TWO two"), (5, "w0 end tail the")],
        "item_id bigint, text string",
    )
    index = maxscore.build_index(odd)
    want = brute_search([(i, t) for i, t, *_ in ODD], {tuple(r) for r in items.collect()})
    assert rows_of(maxscore.search(index, items)) == want
    assert maxscore.search(maxscore.build_index(none), items).count() == 0
    assert maxscore.search(index, items.limit(0)).count() == 0


def test_pruning_is_exact_and_rejects_before_unpacking():
    """Random lists with one rare heavy term and frequent light ones: most blocks stay packed, and ties keep the smaller place."""
    r = np.random.default_rng(3)
    n = 60_000
    sizes, weights = [30, 100, 45_000, 55_000, 30_000], [900, 300, 3, 2, 1]
    lists, dense = [], np.zeros(n, np.int64)
    for size, w in zip(sizes, weights):
        doc = np.sort(r.choice(n, size, replace=False))
        impact = r.integers(1, 50, size)
        dense[doc] += w * impact
        starts = np.arange(0, size, maxscore.BLOCK)
        packed = []
        for a in starts:
            own = np.zeros(min(maxscore.BLOCK, size - a), maxscore.POSTING)
            own["gap"] = np.diff(doc[a : a + len(own)], prepend=0)
            own["impact"] = impact[a : a + len(own)]
            packed.append(own.tobytes())
        ends = np.minimum(starts + maxscore.BLOCK, size) - 1
        lists.append(maxscore.Postings(doc[ends], np.maximum.reduceat(impact, starts), pa.array(packed, pa.binary())))
    docs, scores = maxscore.best_of_shard(lists, weights, n, 20)
    want = np.lexsort((np.arange(n), -dense))[:20]
    assert docs.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()
    assert sum(len(p.open) for p in lists[2:]) < 0.5 * sum(len(p.last) for p in lists[2:])
