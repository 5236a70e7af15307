"""Licence scan: a paragraph classifier confirmed by templates, with DataFrame functions only.

A multinomial logistic regression on word one- and two-grams gives each paragraph
(line) a probability for every licence family and for "unknown". It is trained
on the templates below, their sentences, crops and thinned copies, against
at most ``ordinary`` paragraphs of the corpus without a licence word; a
temperature fitted on copies kept apart calibrates it. Only paragraphs with a
key term (a word that speaks for some family) are scored; any other is unknown
by the definition of the model. A predicted family is confirmed if a template of
it holds enough of the paragraph's word three-grams.

Weights and templates have a fixed size and are broadcast. Defined cases: null
and empty texts have no paragraphs; a paragraph repeated in a document counts
each time; rows that share id and text get the same result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
THRESHOLD = 0.5  # probability of a family
CONFIRMED = 0.5  # share of a paragraph's three-grams in one template

# Public notices by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license. See the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "Licensed under the GPL, version 2 or later."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("lgpl", "Licensed under the LGPL, version 2.1."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("isc", "Released under the ISC License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
# Ordinary sentences with words that licences use too.
LOOKALIKES = [
    "He lost his driving licence last year.",
    "The software was released in version 2 last week.",
    "Permission to build was granted by the city.",
    "A copy of the letter was free of charge.",
    "The general public was not allowed to use the work.",
    "Copyright law differs between countries.",
    "You may not use the door in the north wing.",
    "The conditions are met in most cases.",
    "The foundation published its report under a new name.",
    "The international version of the work is for sale.",
]


def _clean(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def _grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the last is unknown
    grams: tuple[str, ...]
    weights: np.ndarray  # a row each gram, then the offsets
    key_terms: tuple[str, ...]

    def probabilities(self, paragraph: str) -> np.ndarray:
        """The same decision outside Spark, for tests."""
        words = _clean(paragraph)
        place = {g: i for i, g in enumerate(self.grams)}
        line = self.weights[-1].copy()
        if not set(words) & set(self.key_terms):
            return np.eye(len(self.families))[-1]
        for g in set(words) | set(_grams(words, 2)):
            if g in place:
                line += self.weights[place[g]]
        p = np.exp(line - line.max())
        return p / p.sum()


def _copies(words: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The words, crops of at least four of them, and copies with some words lost."""
    out = [words]
    for _ in range(n):
        if len(words) > 6 and rng.random() < 0.5:
            size = int(rng.integers(4, len(words)))
            start = int(rng.integers(0, len(words) - size + 1))
            out.append(words[start : start + size])
        else:
            out.append([w for w in words if rng.random() > 0.1] or words)
    return out


def fit_licences(docs: DataFrame, ordinary: int = 2000, copies: int = 30, seed: int = 3) -> LicenceModel:
    rng = np.random.default_rng(seed)
    families = (*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN)
    rows, marks = [], []
    for family, text in TEMPLATES:
        for words in _copies(_clean(text), rng, copies):
            rows.append(words)
            marks.append(families.index(family))
    lines = _paragraphs(docs).filter(~F.col("paragraph").rlike("(?i)licen[sc]|copyright|creative commons"))
    plain = lines.select("paragraph").distinct().orderBy(F.xxhash64("paragraph")).limit(ordinary)
    for text in [*LOOKALIKES * 5, *(r[0] for r in plain.collect())]:
        rows.append(_clean(text))
        marks.append(len(families) - 1)
    grams = tuple(sorted({g for _, t in TEMPLATES for n in (1, 2) for g in _grams(_clean(t), n)}))
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1))
    x[:, -1] = 1.0
    for i, words in enumerate(rows):
        for g in {*words, *_grams(words, 2)}:
            if g in place:
                x[i, place[g]] = 1.0
    y = np.eye(len(families))[marks]
    apart = rng.random(len(rows)) < 0.2
    w, step = np.zeros((len(grams) + 1, len(families))), 0.5
    speed = np.zeros_like(w)
    share = 1.0 / np.maximum(y[~apart].sum(axis=0), 1)
    cost = (y[~apart] @ share)[:, None]
    cost /= cost.mean()
    for _ in range(600):
        p = np.exp((line := x[~apart] @ w) - line.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x[~apart].T @ (cost * (p - y[~apart])) / (~apart).sum() + 1e-4 * w
        speed = 0.9 * speed - step * slope
        w = w + speed
    best = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: _loss(x[apart] @ w * t, y[apart]))
    w = w * best
    gain = (w[:-1, :-1] - w[:-1, -1:]).max(axis=1)
    usual = x[np.array(marks) == len(families) - 1, :-1].mean(axis=0)
    key = tuple(g for i, g in enumerate(grams) if " " not in g and gain[i] > 0.5 and usual[i] < 0.02)
    return LicenceModel(families, grams, w, key)


def _loss(line: np.ndarray, y: np.ndarray) -> float:
    line = line - line.max(axis=1, keepdims=True)
    return float(-(y * (line - np.log(np.exp(line).sum(axis=1, keepdims=True)))).sum())


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, at and paragraph: the lines of a text that hold more than white space."""
    lines = F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\n+")).alias("at", "paragraph")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), lines).filter(F.col("paragraph").rlike(r"\S"))


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def _gram_list(words: Column, n: int) -> Column:
    """Runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of fixed size as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def scan_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, text_key, at, family, probability, similarity, confirmed of every paragraph that is not unknown."""
    spark = docs.sparkSession
    keys = ["doc_id", "text_key", "at"]
    lines = _paragraphs(docs).withColumn("words", _word_list(F.col("paragraph")))
    some = lines.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in model.key_terms]))).select(*keys, "words")
    k = len(model.families)
    grams = F.array_distinct(F.concat(F.col("words"), _gram_list(F.col("words"), 2)))
    table = _small(spark, [{"gram": g, "w": [float(v) for v in row]} for g, row in zip(model.grams, model.weights[:-1])], "gram:string,w:array<double>")
    met = some.select(*keys, F.explode(grams).alias("gram")).join(F.broadcast(table), "gram")
    # Fixed-point sums, so that the order of addition does not show.
    sums = met.groupBy(*keys).agg(*[F.sum(F.round(F.col("w")[i] * 1e9).cast("bigint")).alias(f"s{i}") for i in range(k)])
    line = F.array(*[F.col(f"s{i}") / 1e9 + F.lit(float(model.weights[-1, i])) for i in range(k)])
    scored = sums.select(*keys, line.alias("line")).withColumn("top", F.array_max("line"))
    total = F.aggregate("line", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names = F.array(*[F.lit(f) for f in model.families])
    scored = scored.select(*keys, F.get(names, F.array_position("line", F.col("top")).cast("int") - 1).alias("family"), (1 / total).alias("probability"))
    scored = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= THRESHOLD))

    pieces = sorted({(f, i, g) for i, (f, t) in enumerate(TEMPLATES) for g in _grams(_clean(t), min(3, len(_clean(t))))})
    templates = _small(spark, [{"piece": g, "template": i, "of": f} for f, i, g in pieces], "piece:string,template:int,of:string")
    own = some.withColumn("pieces", F.array_distinct(_gram_list(F.col("words"), 3)))
    own = own.select(*keys, F.size("pieces").alias("n"), F.explode("pieces").alias("piece"))
    shared = own.join(F.broadcast(templates), "piece").groupBy(*keys, "n", "of", "template").agg(F.count(F.lit(1)).alias("m"))
    near = shared.groupBy(*keys, F.col("of").alias("family")).agg(F.max(F.col("m") / F.col("n")).alias("similarity"))
    same = F.lit(True)
    for c in [*keys, "family"]:
        same = same & scored[c].eqNullSafe(near[c])
    out = scored.join(near, same, "left").select(*[scored[c] for c in keys], scored["family"], "probability", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return out.withColumn("confirmed", F.col("similarity") >= CONFIRMED)


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, families (confirmed, sorted), unconfirmed (predicted only), n_found and best (highest probability) of every row."""
    found = scan_paragraphs(docs, model).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.array_sort(F.collect_set(F.when(~F.col("confirmed"), F.col("family")))).alias("unconfirmed"),
        F.count(F.lit(1)).alias("n_found"),
        F.max("probability").alias("best"),
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])
    return rows.join(found, same, "left").select(
        rows["doc_id"],
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce(F.array_join("unconfirmed", ","), F.lit("")).alias("unconfirmed"),
        F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_found"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
    )
