"""Results against brute force, exact round trips, SQL twins, or held-out accuracy."""

import heapq
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ocuspark.llm import licenses, mixing, pieces, queries, quality, search, simhash, substring, warc
from ocuspark.llm.text import table

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="test tables not present")


def texts(spark, folder):
    return [(r[0], r[1]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


def planted(rng):
    """Groups of copies, near copies, and passages inside other texts, over few words, so that much collides."""
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(12)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.5:
            other = rng.choice(base)
            text = text[: rng.randint(0, len(text))] + other[rng.randint(0, len(other)) :] + text
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_equals_brute_force(spark, seed):
    rows = planted(random.Random(seed))
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == substring.brute_force(rows)


def test_op2_equals_brute_force(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_substring_dedup(spark, TINY).collect()}
    assert found == substring.brute_force(texts(spark, TINY))


def brute_components(fps):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_op9_equals_brute_force(spark):
    import xxhash

    def fingerprint(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [(i, fingerprint(t)) for i, t in texts(spark, TINY)]
    found = queries.op9_simhash_near_dedup(spark, TINY).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{f:016x}" for i, f in fps}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(fps)


@pytest.mark.parametrize("large", [3, 512])
def test_hamming_links_are_complete(spark, large):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for c in centres for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3, large)
    found = {(r["a"], r["b"]) for r in links.collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == want


def test_pigeonhole_plans_cover_the_distance():
    sample = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    for n in (100, 10**6, 10**10):
        plan = simhash.allocate(sample, n, 3)
        assert sorted(b for part, _ in plan for b in part) == list(range(64))
        assert sum(t for _, t in plan) == 3 - len(plan) + 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(7, 400)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[400] == 0 and all(found[i] == 100 for i in range(100, 300))


def test_op10_equals_brute_force(spark):
    rows = texts(spark, TINY)
    found = sorted(tuple(r) for r in queries.op10_block_max_search(spark, TINY).collect())
    assert found == sorted(search.brute_force(rows, [r for r in rows if r[0] % 100 == 0]))


def test_search_over_shards_and_pruned_blocks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(int(rng.expovariate(0.2))) for _ in range(rng.randint(1, 30)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = docs.filter("doc_id % 70 = 0").selectExpr("doc_id AS query_id", "text")
    found = sorted(tuple(r) for r in search.top_k(docs, asked, k=4, shard_docs=250).collect())
    assert found == sorted(search.brute_force(rows, [r for r in rows if r[0] % 70 == 0], 4))
    # A rare word lives in one block: the others are never scored.
    n = 4096
    shard = search.Shard(np.arange(n), np.append(np.arange(n), 9), np.append(np.zeros(n, np.int64), 1), np.ones(n + 1, np.int64), np.full(n, 5), np.arange(2).astype(np.uint64), np.array([n, 1.0]), n, 5.0)
    assert shard.top(np.array([0, 1]), 1)[0].tolist() == [9] and shard.scored_blocks < shard.all_blocks


def test_op5_edits_and_likeness(spark):
    import hashlib

    rows = sorted(texts(spark, SMALL))
    found = {r["doc_id"]: r for r in queries.op5_imatch_fingerprints(spark, SMALL).collect()}
    same = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[doc]["n_chars"] == len(text)
        assert same.setdefault(text, found[doc]["fingerprint"]) == found[doc]["fingerprint"]
    edited = np.array([r["near_edited"] for r in found.values()])
    other = np.array([r["near_next"] for r in found.values()])
    assert edited.mean() > 0.5 and other.mean() < 0.05 and (edited[:, None] > other).mean() > 0.95


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    cursor = con.execute(queries.CHECKS[name])
    columns = [c[0] for c in cursor.description]
    found = queries.QUERIES[name](spark, TINY)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


def test_mix_takes_the_quotas_of_highest_quotients(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaaaabbc") if i % 50 else None, "w " * rng.randint(0, 40)) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    sizes, targets, taken = {}, {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, want = set(order), {}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = sum(sizes.values())
    while True:
        rest = total - sum(want.values())
        share = {s: weight[s] * rest / sum(weight[t] for t in left) for s in left}
        full = [s for s in left if share[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            left.discard(s)
    want |= share
    assert all(math.isclose(targets[s], want[s]) for s in order)
    block = found[0]["b"]
    seats = (2 * total + block) // (2 * block)
    heap = [(-want[s], k, s, 0) for k, s in enumerate(order)]
    heapq.heapify(heap)
    quota = dict.fromkeys(order, 0)
    for _ in range(seats):
        _, k, s, q = heapq.heappop(heap)
        quota[s] += 1
        heapq.heappush(heap, (-want[s] / (2 * q + 3), k, s, q + 1))
    assert all(abs(taken[s] - quota[s] * block) <= 2 * block for s in order)
    assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 2 for s in order)


def test_sampled_segmentations_follow_their_weights():
    vocabulary = pieces.Vocabulary(("", " ", "a", "b", "ab", " a", "aba"), (0.0, 0.2, 0.2, 0.1, 0.2, 0.2, 0.1), (0,) * 256)
    sampler = pieces.Sampler(vocabulary, seed=4)
    drawn = sampler.encode(["abab"] * 40000, np.arange(40000))
    counts = {}
    for d in drawn:
        counts[tuple(d.tolist())] = counts.get(tuple(d.tolist()), 0) + 1

    def ways(text):
        if not text:
            yield (), 1.0
        for i, p in enumerate(vocabulary.pieces):
            if p and text.startswith(p):
                for rest, w in ways(text[len(p) :]):
                    yield (i, *rest), vocabulary.weights[i] * w

    exact = dict(ways(" abab"))
    total = sum(exact.values())
    assert set(counts) <= set(exact)
    for way, w in exact.items():
        p = w / total
        assert abs(counts.get(way, 0) - 40000 * p) < 5 * math.sqrt(40000 * p) + 1
    assert [d.tolist() for d in sampler.encode(["abab"], np.array([7]))] == [drawn[7].tolist()]


def test_op8_is_lossless_and_repeatable(spark):
    first = queries.op8_piece_sampling(spark, TINY).collect()
    again = queries.op8_piece_sampling(spark, TINY).collect()
    assert all(r["lossless"] for r in first) and sorted(first) == sorted(again)
    import sentencepiece
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, TINY, "documents").limit(20)
    plain = dict(docs.select("doc_id", "text").collect())
    for r in pieces.encode(docs, pieces.default_vocabulary(spark)).collect():
        assert model.decode(list(r["pieces"])) == plain[r["doc_id"]]


def test_op7_equals_the_model_outside_spark(spark):
    docs = table(spark, TINY, "documents").filter("doc_id < 60")
    lines = [
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.", "The licence of the driver was free of charge.", "free software under version", "Just words.",
    ]
    extra = spark.createDataFrame([(1000 + i, f"{a}\n{b}") for i, a in enumerate(lines) for b in ("x", lines[-2])], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    model = licenses.fit_licences(docs)
    found = {(r["doc_id"], r["at"], r["text_key"]): r for r in licenses.scan_paragraphs(both, model).collect()}
    want = {}
    for doc, key, text in both.select("doc_id", F.xxhash64("text"), "text").collect():
        for at, line in enumerate(__import__("re").split(r"\n+", text)):
            p = model.probabilities(line)
            if line.strip() and p.argmax() < len(p) - 1 and p.max() >= licenses.THRESHOLD:
                want[doc, at, key] = (model.families[p.argmax()], p.max())
    assert found.keys() == want.keys()
    assert all(found[k]["family"] == f and math.isclose(found[k]["probability"], p, rel_tol=1e-6) for k, (f, p) in want.items())
    assert {r["family"] for r in found.values() if r["confirmed"]} >= {"mit", "apache", "gpl", "cc-by-nc"}


def accuracy(rows, marks):
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    return held


def test_op1_held_out(spark):
    marks = dict(table(spark, SMALL, "labels").select("doc_id", "quality").collect())
    held = accuracy(queries.op1_compression_quality(spark, SMALL).collect(), marks)
    assert sum(p == m for p, m in held) >= 0.9 * len(held)


def test_op6_held_out(spark):
    marks = dict(table(spark, SMALL, "labels").select("doc_id", "toxic").collect())
    held = accuracy(queries.op6_string_kernel_toxicity(spark, SMALL).collect(), marks)
    assert sum(p == m for p, m in held) >= 0.9 * len(held)
    assert sum(p for p, m in held if m) >= 0.5 * sum(m for _, m in held)


def test_kernel_tolerates_inserted_characters():
    from ocuspark.llm import toxicity as x

    words = ["idiot", "id-iot", "i.d.i.o.t", "banana", "idio"]
    k = x.kernel([x._profile("idiot")], [x._profile(w) for w in words])[0]
    assert math.isclose(k[0], 1.0, rel_tol=1e-5) and k[1] > 0.3 and k[2] > 0.05 and k[3] == 0.0


def test_op3_records_parse_and_keep_their_sources(spark):
    pages = table(spark, TINY, "pages")
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    records = warc.derive(warc.responses(pages))
    rows = {r["record_id"]: r for r in records.collect()}
    for r in warc.serialised(records).collect():
        ((fields, block),) = warc.parse(bytes(r["record"]))
        row = rows[r["record_id"]]
        origin = source[fields["WARC-Refers-To"]]
        assert block.decode() == row["block"] and fields["WARC-Block-Digest"] == warc.digest(block)
        assert fields["WARC-Refers-To-Payload-Digest"] == warc.digest(origin["payload"].encode())
        assert rows[fields["WARC-Concurrent-To"]]["page_id"] == origin["page_id"]
        assert "<p>" not in row["block"] and "track(" not in row["block"]
    assert len(rows) == 2 * pages.count()


def test_plain_text_and_links():
    page = "<title>A &amp; B</title><script>x</script><!-- c --><p>one  two</p><a href='/p?q=1&amp;r=2'>three</a><br>four<style>p{}"
    body = warc.scan_page(page)
    assert warc.plain_text(body) == "A & B\none two\nthree\nfour"
    assert warc.metadata(body, "http://e.org/d/")["links"] == ["http://e.org/p?q=1&r=2"]


def jaccard_heads(rows, width=5, similarity=0.8):
    """Smallest ids of the components that all pairs of texts with exact five-word similarity 0.8 or more make."""
    sets, root = [], {i: i for i, _ in rows}
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(rows):
        for m in range(n):
            shared = len(sets[n] & sets[m])
            if shared >= similarity * (len(sets[n]) + len(sets[m]) - shared):
                x, y = find(i), find(rows[m][0])
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_pipeline_equals_its_parts(spark):
    """Each stage on what its predecessor kept, beside plain Python versions of the stages that have one."""
    docs = table(spark, TINY, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "pieces"]
    good = stages["quality"](spark, docs, TINY)
    model = quality.fit_quality(docs, table(spark, TINY, "labels"))
    sizes = quality._Sizes(model.good, model.bad)
    kept = {i for i, t in texts(spark, TINY) if model.probability(np.array([sizes.raw(t.encode())]))[0] >= 0.3}
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {i for i, _ in rows} == kept
    one = stages["near_dedup"](spark, good, TINY)
    want = jaccard_heads(rows)
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert {i for i, _ in rows} == want
    clean = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, one, TINY).collect()}
    import hashlib

    want = substring.brute_force(rows)
    assert {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in clean.items()} == {i: w[2] for i, w in want.items()}
    out = corpus_pipeline.run(spark, TINY)
    taken = mixing.mix(stages["substring_dedup"](spark, one, TINY))
    back = pieces.decode(out, pieces.default_vocabulary(spark)).collect()
    assert sum(len(r["text"].split()) for r in back) == taken.agg(F.sum("taken")).first()[0]
