"""Monotone scores, and insults written with gaps, on the given labelled documents."""

import numpy as np
import pytest

from ocuspark.llm import toxicity
from ocuspark.llm.text import table

CLEAN = "The committee met on Tuesday to review the budget for the new library"


@pytest.fixture(scope="module")
def judges(spark):
    out = {}
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        model = toxicity.fit_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
        words = [r["text"] for r in table(spark, folder, "documents").filter("doc_id < 60 AND text IS NOT NULL").select("text").collect()]
        out[sf] = toxicity.Judge(model), sorted({w for t in words for w in t.split()})
    return out


def score(judge, texts):
    return judge.model.probability(judge.worst(texts))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_a_further_word_never_lowers_a_score(judges, sf):
    judge, words = judges[sf]
    base = [CLEAN, CLEAN + " idiot", CLEAN + " idiot moron", ""]
    for text, before in zip(base, score(judge, base)):
        more = score(judge, [f"{text} {w}" for w in [*words, "idiot", "i.d.i.o.t", "mo-ron"] if len(w) > 1])
        assert more.min() >= before - 1e-12


@pytest.mark.parametrize("write", [".".join, "*".join, " ".join, lambda w: w[:2] + "-" + w[2:], lambda w: w[:2] + w[2] * 3 + w[3:]])
def test_gapped_words_score_as_the_word(judges, write):
    judge, words = judges["sf0.01"]
    plain = [w for w in words if w.isalpha() and w.islower() and len(w) > 4][:300]
    plain = [w for w in plain if len(set(zip(w, w[1:]))) == len(w) - 1 and all(a != b for a, b in zip(w, w[1:]))]
    assert (score(judge, [write(w) for w in plain]) >= score(judge, plain) - 1e-12).all()


def test_rising_fit_has_no_negative_slope_and_keeps_the_best_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 1] - 0.8 * x[:, 0] + rng.normal(size=400) > 0).astype(float)
    a, b, _ = toxicity.rising_fit(x, y)
    assert a == 0 and b > 0
    free = toxicity.rising_fit(x, (x.sum(axis=1) + rng.normal(size=400) > 0).astype(float))
    assert min(free[:2]) > 0
