"""F1: where block maxima do not prune, a group of queries is scored by one product, with the same results."""

import random

import numpy as np
import pytest

from ocuspark.llm import search


@pytest.mark.parametrize("n_docs", [3, 700])
def test_product_equals_block_search(n_docs):
    rng = np.random.default_rng(n_docs)
    n_terms = 90
    pairs = {(d, t) for d in range(n_docs) for t in rng.zipf(1.3, 25) if t < n_terms}
    rows, terms = (np.array(x, dtype=np.int64) for x in zip(*sorted(pairs)))
    df = np.maximum(np.bincount(terms, minlength=n_terms), 1).astype(float)
    ids = rng.permutation(n_docs) // 2  # equal ids too
    shard = search.Shard(ids, rows, terms, rng.integers(1, 4, len(rows)), np.full(n_docs, 25), np.arange(n_terms).astype(np.uint64), df, n_docs, 25.0)
    asked = [np.unique(rng.integers(0, n_terms, m)) for m in (1, 5, 40, 200)] + [np.zeros(0, np.int64)]
    want = [shard.top(q, 10) for q in asked]
    for found, (docs, scores) in zip(shard.top_of_group(asked, [0.0] * len(asked), 10), want):
        assert found[1].tolist() == scores.tolist() and ids[found[0]].tolist() == ids[docs].tolist()
    # With a floor, only documents below it may be missing.
    floors = [float(scores[2]) if len(scores) > 2 else 0.0 for _, scores in want]
    for found, (_, scores), floor in zip(shard.top_of_group(asked, floors, 10), want, floors):
        assert [s for s in found[1] if s >= floor] == [s for s in scores if s >= floor]


def test_queries_after_the_trial_use_the_product(monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcd") + str(int(rng.expovariate(0.1))) for _ in range(rng.randint(0, 20)))) for i in range(600)]
    made, groups = search.Shard.top_of_group, []

    def watched(self, asked, floors, k):
        groups.append(len(asked))
        return made(self, asked, floors, k)

    monkeypatch.setattr(search, "GROUP", 8)
    monkeypatch.setattr(search.Shard, "top_of_group", watched)
    pack = search.zstandard.ZstdCompressor().compress
    docs = search.pa.table({"doc_id": [i for i, _ in rows], "packed": [pack(t.encode()) for _, t in rows]})
    asked = [r for r in rows if r[0] % 20 == 0]
    bags = list(search._pieces(search.pa.array([t for _, t in rows])))
    known, df = np.unique(np.concatenate([bag[1] for _, bag in bags]), return_counts=True)
    packed = []
    for _, text in asked:
        own = next((bag[1] for _, bag in search._pieces(search.pa.array([text]))), known[:0])
        own = own[np.argsort(own)]
        packed.append(np.concatenate([own.astype("<i8").view(np.uint8), df[np.searchsorted(known, own)].astype("<i8").view(np.uint8)]).tobytes())
    queries = search.pa.table({"query_id": [i for i, _ in asked], "query_key": [0] * len(asked), "packed": search.pa.array(packed, search.pa.binary())})
    mean = sum(len(t.split()) for _, t in rows) / len(rows)
    out = search._search_shard(4, len(rows), mean)(docs, queries).to_pylist()
    assert groups and max(groups) == 8
    got = sorted((r["query_id"], -r["score"], r["doc_id"]) for r in out)
    want = sorted((q, -round(s * search.SCALE), d) for q, _, d, s in search.brute_force(rows, asked, 4))
    assert got == want
