import random

import numpy as np
import pyarrow as pa
import zstandard

from ocuspark.llm import search


def test_no_task_holds_all_queries(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(int(rng.expovariate(0.2))) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = docs.filter("doc_id % 4 = 0").selectExpr("doc_id AS query_id", "text")
    made = search._search_shard

    def watched(*settings):
        inner = made(*settings)

        def run(shard, queries):
            if queries.num_rows > 60:
                raise ValueError(f"{queries.num_rows} of 100 queries in one task")
            return inner(shard, queries)

        return run

    monkeypatch.setattr(search, "_search_shard", watched)
    monkeypatch.setattr(search.top_k, "__defaults__", (*search.top_k.__defaults__[:2], 300))
    found = sorted(tuple(r) for r in search.top_k(docs, asked, k=4, shard_docs=150).collect())
    assert found == sorted(search.brute_force(rows, [r for r in rows if r[0] % 4 == 0], 4))


def test_a_shard_is_indexed_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcd") + str(int(rng.expovariate(0.2))) for _ in range(rng.randint(0, 12)))) for i in range(700)]
    monkeypatch.setattr(search, "SLICE_WORDS", 500)
    table = pa.table({"doc_id": [i for i, _ in rows], "packed": [zstandard.ZstdCompressor().compress(t.encode()) for _, t in rows]})
    terms = np.unique(np.concatenate([bag[1] for _, bag in search._pieces(pa.array([t for _, t in rows]))]))
    sizes = [s.n_docs for s in search._slices_of(table, terms, np.ones(len(terms)), 700, 6.0)]
    assert sizes == [256, 256, 188]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = [r for r in rows if r[0] % 50 == 0]
    found = sorted(tuple(r) for r in search.top_k(docs, spark.createDataFrame(asked, "query_id bigint, text string"), k=4).collect())
    assert found == sorted(search.brute_force(rows, asked, 4))
