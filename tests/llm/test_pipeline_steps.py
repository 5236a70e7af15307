"""what the pipeline's stages do once instead of several times, with the same results."""

import random

import numpy as np

from ocuspark.llm import mixing, similar
from ocuspark.llm.text import U64


def test_sketches_of_many_texts_are_those_of_each():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)).encode() for n in (1, 2, 4, 30, 1500)]
    low = np.array([similar.minima(similar.shingles(t)) for t in texts])
    assert (similar.band_keys(low) == np.array([similar.band_keys(x) for x in low])).all()
    for t, row in zip(texts, low):
        own = similar.shingles(t)
        assert (row == ((own[None, :] ^ similar._SEEDS[0]) * (similar._SEEDS[1] | U64(1))).min(axis=1)).all()
        long, short = similar._hashes(t, similar.WIDTH, 3)
        assert (np.unique(long) == own).all()
        ones = [sum(int(h) >> b & 1 for h in short) for b in range(64)]
        assert similar.fingerprint(short) == sum(1 << b for b in range(64) if 2 * ones[b] > len(short))
    assert similar.fingerprint(similar._hashes(b"", 3)[0]) == 0


def test_mixing_shuffles_texts_once(spark):
    """Duplicates and the join meet by one key; a row with null id and source, twice there, is kept twice as often."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "b"]), " ".join(f"w{j}" for j in range(rng.randrange(1, 90)))) for i in range(300)]
    rows += [(None, None, "x y z")] * 2 + [(7, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    shown = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mix_documents(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", shown)
    assert plan.count("Exchange hashpartitioning(_m#") == 1 and "Exchange hashpartitioning(cast(_m#" not in plan
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect())

    # Word by word: whether its block is taken once more.
    want = []
    texts = {(i, s): t for i, s, t in rows}
    for r in mixing.mix(docs).filter("taken > 0").collect():
        words = texts[r.doc_id, r.source].split()
        whole = [" ".join(words)] * r.every
        more = []
        for at, w in enumerate(words):
            block = (r.place + at) // r.b
            if r.extra and ((block + 1) * r.extra + r.start) // r.n > (block * r.extra + r.start) // r.n:
                more.append(w)
        want += [(r.doc_id is None, r.doc_id or 0, t) for t in whole + [" ".join(more)] * bool(more)]
    assert got == sorted(want)
