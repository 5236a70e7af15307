"""Taken words against targets that are computed here, without the statements of the operator."""

import random

import pytest

from ocuspark.llm import mixing


def water_level(sizes: dict) -> dict:
    """Targets by sources in code point order, null last, weights 1, 2, 3, none above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, done, left = sum(sizes.values()), {}, set(order)
    while left:
        rest, weights = total - sum(done.values()), sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * rest / weights > 3 * sizes[s]]
        if not full:
            return done | {s: weight[s] * rest / weights for s in left}
        done |= {s: 3.0 * sizes[s] for s in full}
        left -= set(full)
    return done


def rows_of(kind: str) -> list[tuple]:
    rng = random.Random(4)
    if kind == "many sources":
        return [(i, f"s{i % 300:03}", "w " * 200) for i in range(6000)]
    if kind == "small beside large":
        return [(i, "small" if i % 400 == 0 else "large", "w " * 30) for i in range(8000)]
    return [(i, rng.choice(["a", "a", "a", "b", None]), "w " * rng.randint(1, 400)) for i in range(4000)]


@pytest.mark.parametrize("kind", ["many sources", "small beside large", "uneven"])
@pytest.mark.parametrize("shard_docs", [3, 5000])
def test_taken_comes_within_one_percent_of_the_target(spark, monkeypatch, kind, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    rows = rows_of(kind)
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    sizes, taken, targets = {}, {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water_level(sizes)
    assert all(abs(targets[s] - want[s]) < 1e-6 * want[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want), {s: taken[s] / want[s] for s in want}
