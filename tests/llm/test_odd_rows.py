"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from ocuspark.llm import imatch, licenses, mixing, pieces, quality, search, simhash, substring, toxicity, warc

from .conftest import ODD

N = len(ODD)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return pieces.default_vocabulary(spark)


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


ALL = Counter(i for i, *_ in ODD)


def test_quality(odd, none, labels, no_labels):
    for marks in (labels, no_labels):
        model = quality.fit_quality(odd, marks)
        rows = quality.score_quality(odd, model).collect()
        assert ids(rows) == ALL and all(0 <= r["score"] <= 1 for r in rows)
        assert quality.keep_quality(odd, model).columns == odd.columns
    empty = quality.fit_quality(none, no_labels)
    assert quality.score_quality(none, empty).count() == quality.keep_quality(none, empty).count() == 0


def test_toxicity(odd, none, labels, no_labels):
    for marks in (labels, no_labels):
        model = toxicity.fit_toxicity(odd, marks)
        rows = toxicity.score_toxicity(odd, model).collect()
        assert ids(rows) == ALL and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, no_labels)).count() == 0


def test_substring(odd, none):
    rows = substring.remove_repeats(odd, digest=True).collect()
    assert ids(rows) == ALL
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[1, 43]["n_removed"] == 0 and by[2, 43]["n_removed"] == 43 and by[2, 43]["kept"] == ""
    assert by[3, 43]["n_removed"] == 40 and by[3, 43]["kept"] == "a new start"
    assert [tuple(s) for s in by[3, 43]["repeats"]] == [(3, 43)]
    assert by[8, 9001]["n_removed"] == 9000 and by[8, 9001]["kept"] == "tail"
    assert by[None, 40]["n_removed"] == 0  # no id: neither removes nor loses
    assert by[4, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    out = substring.without_repeats(odd)
    assert out.columns == odd.columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[4]["text"] is None and texts[6]["text"] == " \n\t " and texts[3]["n_chars"] == len("a new start")
    assert substring.without_repeats(none).count() == 0


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert ids(rows) == ALL
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] in (4, 5, 6)} == {4: 0, 5: 0, 6: 0}
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert +words == +taken
    assert mixing.mix(none).count() == mixing.mix_documents(none).count() == 0


def test_imatch(odd, none):
    rows = imatch.fingerprints(odd).collect()
    assert ids(rows) == ALL
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert imatch.fingerprints(none).count() == 0


def test_licences(odd, none):
    model = licenses.fit_licences(odd)
    rows = licenses.scan(odd, model).collect()
    assert ids(rows) == ALL and all(r["families"] == "" for r in rows)
    assert licenses.scan(none, licenses.fit_licences(none)).count() == 0


def test_pieces(odd, none, vocabulary):
    coded = pieces.encode(odd, vocabulary)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(coded, vocabulary).collect())
    assert back == Counter((i, t) for i, t, *_ in ODD)
    assert all(r["lossless"] for r in pieces.encode_digests(odd, vocabulary).collect())
    assert pieces.encode(none, vocabulary).count() == 0


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert ids(rows) == ALL
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["fp"] == by[5]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 4
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    left = ids(kept.collect())
    assert left[2] == 0 and left[1] == 1 and left[9] == 1 and left[None] == 2
    assert simhash.near_duplicates(none).count() == simhash.keep_representatives(none).count() == 0


def test_search(odd, none):
    asked = odd.filter("doc_id = 10 OR doc_id = 5").selectExpr("doc_id AS query_id", "text", "score", "anchor")
    rows = search.top_k(odd, asked, k=3).collect()
    assert {r["query_id"] for r in rows} == {10}  # an empty query finds nothing
    first = {r["doc_id"] for r in rows if r["rank"] == 1}
    assert first == {10}
    assert search.top_k(none, asked).count() == search.top_k(odd, asked.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "http://e.org/a", "<p>x</p>", "k"), (1, "http://e.org/a", "<p>x</p>", "k"), (None, None, None, None), (2, "", "", ""), (3, "http://[bad", "<a href='http://[x'>t" + "<b>" * 5000, "")],
        "page_id bigint, url string, html string, block string",
    )
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 10 and Counter(r["page_id"] for r in rows) == {1: 4, None: 2, 2: 2, 3: 2}
    assert {r["block"] for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion"} == {"x"}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("case", ["odd", "none"])
def test_stages(spark, odd, none, labels, case, scratch):
    labels.write.parquet(f"{scratch}/labels.parquet")
    docs = {"odd": odd, "none": none}[case]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, scratch)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns, name
        out.write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
    if case == "none":
        assert docs.count() == 0
