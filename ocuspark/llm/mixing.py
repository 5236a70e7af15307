"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Targets: the sources in code point order (null last) weigh 1, 2, 3, 1, ... and
share all words; a target stops at three times its source's size and the excess
is shared again by weight (water level over the sorted ratios cap / weight).

Quotas: with block size b a source gets round(target / b) blocks, the outcome of
highest quotients target / (2 k + 1) at divisor b; the few blocks by which the
sum misses words / b are then given to the highest, or taken from the lowest,
quotients. Each source's blocks are dealt to its shards the same way, by size.

Selection: a shard orders its documents by a seeded hash and cuts the stream of
their words into n blocks. A quota q takes every block q div n times, and the
other q mod n blocks at even strides from a seeded start, so the words taken of
a document follow from its place by integer arithmetic: no block becomes a row.

A source of n documents has ceil(n / ``SHARD_DOCS``) shards, cut by the seeded
hash, so one source may hold most rows and a small source is not scattered. The
block size is a thousandth of the smallest average shard, at most 64 words: the
partial last block of a shard, which counts as whole, is a small part of it. The
tables of sources and of shards are the only ones ordered as a whole.

Defined cases: null and empty texts have size 0 and take 0. A null source is a
source of its own. Repeated rows and ids are separate documents. No words at
all: targets and takes are 0. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocuspark.llm.text import word_array, word_count, written

SEED = "mix-1"
BLOCK_WORDS = 64  # at most
CELL_BLOCKS = 1_000  # blocks that the source with the smallest shards has in one of them, so that partial last blocks do not show
SHARD_DOCS = 5_000
CAP = 3

#: Steps over a table ``sized`` (doc_id, source, size), each over those before. ``//`` is integer division.
STEPS = [
    ("keyed", """
  SELECT doc_id, source, size@tie@, md5(concat('@seed@:', coalesce(CAST(doc_id AS VARCHAR(20)), ''))) AS turn FROM sized"""),
    ("scale", """
  SELECT source, (count(*) + @shard_docs@ - 1) // @shard_docs@ AS shards, sum(size) AS own FROM keyed GROUP BY source"""),
    ("total", """
  SELECT coalesce(sum(own), 0) AS words FROM scale"""),
    ("placed", """
  SELECT k.*, @hex@substr(turn, 1, 12)@xeh@ % c.shards AS shard FROM keyed k JOIN scale c ON k.source IS NOT DISTINCT FROM c.source"""),
    ("cells", """
  SELECT source, shard, sum(size) AS cell_size FROM placed GROUP BY 1, 2"""),
    ("sources", """
  SELECT source, sum(cell_size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS pos
  FROM cells GROUP BY source"""),
    ("block", """
  SELECT greatest(1, least(@block_words@, coalesce(min(own // shards), 1) // @cell_blocks@)) AS b FROM scale WHERE own > 0"""),
    ("weighed", """
  SELECT *, (pos - 1) % 3 + 1 AS weight, CAST(@cap@ * source_size AS DOUBLE) / ((pos - 1) % 3 + 1) AS level FROM sources"""),
    ("filling", """
  SELECT *, coalesce(sum(@cap@ * source_size) OVER (ORDER BY level, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY level, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed"""),
    ("judged", """
  SELECT f.*, CAST(weight * (words - below) AS DOUBLE) / rest >= @cap@ * source_size AS capped, words
  FROM filling f CROSS JOIN total"""),
    ("water", """
  SELECT coalesce(sum(CASE WHEN capped THEN @cap@ * source_size END), 0) AS used, sum(CASE WHEN capped THEN 0 ELSE weight END) AS thirst
  FROM judged"""),
    ("targets", """
  SELECT source, source_size, pos, words,
    CASE WHEN capped THEN CAST(@cap@ * source_size AS DOUBLE) ELSE CAST(weight * (words - used) AS DOUBLE) / thirst END AS target
  FROM judged CROSS JOIN water"""),
    ("first_quota", """
  SELECT t.*, b, CAST(floor(target / b + 0.5e0) AS BIGINT) AS quota, (2 * words + b) // (2 * b) AS seats FROM targets t CROSS JOIN block"""),
    ("missing", """
  SELECT *, seats - sum(quota) OVER () AS gap, count(*) OVER () AS parties FROM first_quota"""),
    ("steps", """
  SELECT source, pos, target, quota, gap, @explode@(sequence_up) AS step FROM (
    SELECT *, @sequence@(1, 2 + CAST(floor(target * (abs(gap) + parties) / greatest(words, 1)) AS BIGINT)) AS sequence_up FROM missing) m
  WHERE gap <> 0"""),
    ("ranked", """
  SELECT pos, gap, row_number() OVER (ORDER BY CASE WHEN gap > 0 THEN -target / (2 * (quota + step) - 1) ELSE target / (2 * (quota - step) + 1) END, pos, step) AS place
  FROM steps WHERE gap > 0 OR step <= quota"""),
    ("changes", """
  SELECT pos, sum(CASE WHEN gap > 0 THEN 1 ELSE -1 END) AS change FROM ranked WHERE place <= abs(gap) GROUP BY pos"""),
    ("quotas", """
  SELECT m.source, m.source_size, m.target, m.b, m.quota + coalesce(c.change, 0) AS quota FROM missing m LEFT JOIN changes c ON m.pos = c.pos"""),
    ("cell_first", """
  SELECT c.source, c.shard, c.cell_size, q.source_size, q.target, q.b, q.quota AS seats,
    CASE WHEN q.source_size = 0 THEN 0 ELSE CAST(floor(c.cell_size * (CAST(q.quota AS DOUBLE) / q.source_size) + 0.5e0) AS BIGINT) END AS quota
  FROM cells c JOIN quotas q ON c.source IS NOT DISTINCT FROM q.source"""),
    ("cell_missing", """
  SELECT *, seats - sum(quota) OVER (PARTITION BY source) AS gap, count(*) OVER (PARTITION BY source) AS parties FROM cell_first"""),
    ("cell_steps", """
  SELECT source, shard, cell_size, quota, gap, @explode@(sequence_up) AS step FROM (
    SELECT *, @sequence@(1, 2 + CAST(floor(CAST(cell_size AS DOUBLE) * (abs(gap) + parties) / greatest(source_size, 1)) AS BIGINT)) AS sequence_up FROM cell_missing) m
  WHERE gap <> 0 AND source_size > 0"""),
    ("cell_ranked", """
  SELECT source, shard, gap, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN gap > 0 THEN -CAST(cell_size AS DOUBLE) / (2 * (quota + step) - 1)
    ELSE CAST(cell_size AS DOUBLE) / (2 * (quota - step) + 1) END, shard, step) AS place
  FROM cell_steps WHERE gap > 0 OR step <= quota"""),
    ("cell_changes", """
  SELECT source, shard, sum(CASE WHEN gap > 0 THEN 1 ELSE -1 END) AS change FROM cell_ranked WHERE place <= abs(gap) GROUP BY source, shard"""),
    ("cell_quotas", """
  SELECT m.source, m.shard, m.source_size, m.target, m.b, greatest(1, (m.cell_size + m.b - 1) // m.b) AS n,
    least(m.quota + coalesce(c.change, 0), @cap@ * ((m.cell_size + m.b - 1) // m.b)) AS quota,
    @hex@substr(md5(concat('@seed@:', coalesce(m.source, ''), ':', CAST(m.shard AS VARCHAR(20)))), 1, 12)@xeh@ AS start
  FROM cell_missing m LEFT JOIN cell_changes c ON m.source IS NOT DISTINCT FROM c.source AND m.shard = c.shard"""),
    ("streamed", """
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY turn, size, doc_id@tie@ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place FROM placed"""),
    ("cut", """
  SELECT s.doc_id, s.source, s.size@s_tie@, q.source_size, q.target, s.place, q.b, q.n, q.quota // q.n AS every, q.quota % q.n AS extra, q.start % q.n AS start
  FROM streamed s JOIN cell_quotas q ON s.source IS NOT DISTINCT FROM q.source AND s.shard = q.shard"""),
    ("ends", """
  SELECT *, place // b AS j0, (place + size) // b AS j1 FROM cut"""),
    ("counted", """
  SELECT *, (j0 * extra + start) // n AS c0, ((j0 + 1) * extra + start) // n AS d0,
    (j1 * extra + start) // n AS c1, ((j1 + 1) * extra + start) // n AS d1 FROM ends"""),
    ("mixed", """
  SELECT doc_id, source, size@tie@, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(every * size + b * (c1 - c0) + (place + size - j1 * b) * (d1 - c1) - (place - j0 * b) * (d0 - c0) AS BIGINT) AS taken,
  place, b, n, every, extra, start
FROM counted"""),
]
#: Small tables, and rows of documents, that several later steps read.
WRITTEN = {"scale", "cells", "judged", "targets", "missing", "quotas", "cell_missing", "cell_quotas"}


def _filled(sql: str, **other: str) -> str:
    values = {"seed": SEED, "shard_docs": str(SHARD_DOCS), "block_words": str(BLOCK_WORDS), "cell_blocks": str(CELL_BLOCKS), "cap": str(CAP)} | other
    for name, value in values.items():
        sql = sql.replace(f"@{name}@", value)
    return sql


def check_sql(sized: str) -> str:
    """The same mix in the checking engine's SQL, over a query that gives doc_id, source, size."""
    spelled = {"explode": "unnest", "sequence": "generate_series", "hex": "CAST(concat('0x', ", "xeh": ") AS BIGINT)", "tie": "", "s_tie": ""}
    steps = [("sized", sized), *((name, _filled(sql, **spelled)) for name, sql in STEPS)]
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps) + "\nSELECT * FROM mixed"


def _sized(docs: DataFrame, prefix: str = "") -> list:
    """Key columns of a document; rows that agree in all of them are interchangeable."""
    hashed = [c for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind]
    return [
        F.col("doc_id").cast("bigint").alias(f"{prefix}doc_id"),
        F.col("source").cast("string").alias(f"{prefix}source"),
        word_count(F.col("text").cast("string")).alias(f"{prefix}size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias(f"{prefix}tie"),
    ]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the block pattern at its place, of every document."""
    spark = docs.sparkSession
    spelled = {"explode": "explode", "sequence": "sequence", "hex": "CAST(conv(", "xeh": ", 16, 10) AS BIGINT)", "tie": ", tie", "s_tie": ", s.tie"}
    tables = {"sized": written(docs.select(*_sized(docs)), "mix-sized")}
    for name, sql in STEPS:
        known = "|".join(tables)
        sql = re.sub(rf"\b(FROM|JOIN) ({known})\b", r"\1 {\2}", _filled(sql, **spelled).replace("//", "div"))
        used = {t: df for t, df in tables.items() if "{%s}" % t in sql}
        made = spark.sql(sql, **used)
        tables[name] = written(made, f"mix-{name}") if name in WRITTEN else made
    return tables["mixed"]


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed rows with the columns of docs: one per whole copy taken, and one with the words of blocks taken once more.

    The words of that last row are joined by one space. A document that gives no
    words has no row; n_chars, if present, is set anew.
    """
    keys, pattern = ["doc_id", "source", "size", "tie"], ["place", "b", "n", "every", "extra", "start"]
    # A struct of the keys is not null and equals where all of them are alike, nulls too: by it the texts are shuffled once,
    # for both the duplicates and the join. A null-safe join by single keys would deal them again.
    kind = "struct<doc_id:bigint,source:string,size:bigint,tie:bigint>"  # with the same nullable fields on both sides
    taken = mix(docs).filter("taken > 0").groupBy(F.struct(*keys).cast(kind).alias("_k")).agg(F.collect_list(F.struct(*pattern)).alias("_p"))
    names = docs.columns
    left = docs.select("*", F.struct(*_sized(docs)).cast(kind).alias("_m")).dropDuplicates(["_m"])
    rows = left.join(taken, F.col("_m") == F.col("_k")).withColumn("_p", F.explode("_p"))
    place, b = F.col("_p.place"), F.col("_p.b")

    def selected(block):
        return F.floor(((block + 1) * F.col("_p.extra") + F.col("_p.start")) / F.col("_p.n")) > F.floor(
            (block * F.col("_p.extra") + F.col("_p.start")) / F.col("_p.n")
        )

    def chosen(words):
        """The words of selected blocks, block by block."""
        blocks = F.sequence(F.floor(place / b), F.floor((place + F.greatest(F.size(words), F.lit(1)) - 1) / b))

        def of_block(block):
            first = F.greatest(block * b - place, F.lit(0))
            last = F.least((block + 1) * b - place, F.size(words))
            return F.slice(words, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))

        return F.flatten(F.transform(F.filter(blocks, selected), of_block))

    # In an array of one, so that the text is split once, not for every block.
    split = F.array(word_array(F.col("text").cast("string")))
    once_more = F.array_join(F.element_at(F.transform(split, chosen), 1), " ")
    some = F.when((F.col("_p.extra") > 0), once_more).otherwise("")
    whole = F.array_repeat(F.col("text").cast("string"), F.col("_p.every").cast("int"))
    rows = rows.withColumn("_text", F.explode(F.concat(whole, F.array_remove(F.array(some), ""))))
    out = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return rows.select(*out)
