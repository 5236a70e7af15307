import random

import pytest

import corpus_pipeline
from ocuspark.llm import simhash, similar


def jaccard(a, b, width=5):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return 1.0 if sets[0] == sets[1] else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng):
    """Texts with copies of 1 to 12 edited words: similarities on both sides of 0.8."""
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 400))]
        rows.append(base)
        for _ in range(4):
            copy = list(rng.choice(rows[-4:]))
            for _ in range(rng.randint(1, 12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(copy)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def heads(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i, _ in rows if find(i) == i}


def test_stage_drops_edited_copies(spark):
    rows = edited(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert kept == heads(rows)
    # Many of the pairs lie beyond three bits of the fingerprints.
    prints = [simhash.simhash(t.encode()) for _, t in rows]
    far = [(i, j) for i, a in rows for j, b in rows[:i] if jaccard(a, b) >= 0.8 and (prints[i] ^ prints[j]).bit_count() > 3]
    assert len(far) > 5


def test_a_chain_of_edits_is_one_component(spark):
    """The ends of the chain are not similar to each other."""
    words = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(30):
        words[i * 9] = f"new{i}"
        rows.append((i, " ".join(words)))
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == 30 and {r["component_id"] for r in found} == {0} and jaccard(rows[0][1], rows[-1][1]) < 0.8


@pytest.mark.parametrize("case", ["odd", "none"])
def test_odd_rows(odd, none, case):
    docs = {"odd": odd, "none": none}[case]
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    want = [] if case == "none" else [1, 4, 7, 9, 10, 10, 2**40, None, None]
    # 3 is near 1: 36 of 42 shingles are common.
    assert sorted(left, key=str) == sorted(want, key=str)


def test_a_large_group_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    """Copies with many edits lie in the same bands, but hardly any two are similar: they must not all be compared."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(240):
        copy = list(base)
        for at in rng.sample(range(140), rng.choice([1, 2, 3, 5, 6])):
            copy[at] = f"e{i}x{at}"
        rows.append((i, " ".join(copy)))
    compared, verified = [], similar._verified

    def counted(pairs, texts, similarity):
        compared.append(pairs.count())
        return verified(pairs, texts, similarity)

    monkeypatch.setattr(similar, "_verified", counted)
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in found} == heads(rows)
    assert sum(compared) < 240 * 239 / 2 / 8


def test_components_of_chains_hubs_and_random_edges(spark, monkeypatch):
    """Small slices: neither one slice nor one task sees a whole component."""
    monkeypatch.setattr(simhash, "SLICE", 7)
    rng = random.Random(3)
    names = rng.sample(range(-(10**12), 10**12), 900)
    edges = [(names[i], names[i + 1]) for i in range(300)] + [(names[400], names[i]) for i in range(401, 600)]
    edges += [(rng.choice(names[600:]), rng.choice(names[600:])) for _ in range(250)]
    rng.shuffle(edges)
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + edges[:50], "a bigint, b bigint").repartition(5)
    found = simhash.components(df).collect()
    assert len(found) == len(root) and {r["node"]: r["root"] for r in found} == {n: find(n) for n in root}
    assert simhash.components(df.filter("a = b")).count() == 0


def test_few_stages_are_written(spark, monkeypatch):
    """Each costs a task per shuffle partition however little it holds."""
    labels, written = [], similar.written

    def counted(df, label, *more):
        labels.append(label)
        return written(df, label, *more)

    for module in (simhash, similar):
        monkeypatch.setattr(module, "written", counted)
    rows = edited(random.Random(8))
    similar.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert labels.count("similar-roots") <= 2 and len(labels) <= 40
