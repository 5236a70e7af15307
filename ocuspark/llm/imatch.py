"""Document fingerprints by I-Match, with DataFrame functions only.

Terms whose document frequency lies in a band form the lexicon. A term belongs
to randomised subsets of it: on level l to subset h(term, l) mod MODULI[l], of
which the first SUBSETS are used, so a subset of level l holds one term in
MODULI[l]. A fingerprint has one hash a subset: of the distinct terms the text
has in it. The sorted list of a subset's terms is hashed by the exclusive or of
64-bit term hashes, which gives every order the same value, so no list is built
or sorted. A text without band terms is fingerprinted by its own hash.

Likeness of two fingerprints: twice the equal hashes over all hashes, on the
levels coarse enough for the two texts (at most SPARSE of a level's subsets
used) and the last one.

The lexicon holds at most (mean distinct terms a document) / LOW terms however
many documents there are; it is broadcast while it has under BROADCAST terms and
joined by shuffle beyond.

Documents are ordered by id (null last, ties by text) in chunks between
quantiles of the ids; the first of each chunk is also dealt to the chunk before
it, so a document meets its successor without a global order. Defined cases:
null text is empty; a single document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocuspark.llm.text import word_array, written
from ocuspark.operators.buckets import borders, bucket_count

LOW, HIGH = 0.0005, 0.05
MODULI = (16, 96, 576, 3456)
SUBSETS = 16
SPARSE = 12
BROADCAST = 2_000_000


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term (64-bit hash) of the words in the band, with the subset s0, s1, ... it has on each level (null: none used)."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("word")).select(F.xxhash64("word").alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))
    subset = [F.pmod(F.xxhash64("term", F.lit(level)), F.lit(m)).cast("int") for level, m in enumerate(MODULI)]
    return band.select("term", *[F.when(s < SUBSETS, s).alias(f"s{i}") for i, s in enumerate(subset)])


def with_successor(docs: DataFrame) -> DataFrame:
    """chunk, place, halo, doc_id, text, and next_text, the text of the document with the next id.

    Halo rows close a chunk; they are copies of documents of another chunk.
    """
    inner = sorted({int(b) for b in borders(docs.filter("doc_id IS NOT NULL"), "doc_id", bucket_count(docs))})
    chunk = F.lit(0)
    for b in inner:
        chunk = chunk + F.when(F.col("doc_id") >= b, 1).otherwise(0)
    chunk = F.when(F.col("doc_id").isNull(), len(inner) + 1).otherwise(chunk)
    rows = docs.select("doc_id", "text", chunk.alias("chunk"))
    # One row a chunk: as many as there are partitions.
    firsts = sorted((r["chunk"], r["doc_id"]) for r in rows.groupBy("chunk").agg(F.min("doc_id").alias("doc_id")).collect())
    homes = [F.struct(F.col("chunk"), F.lit(0).alias("late"))]
    for i, (_, first) in enumerate(firsts):
        before = firsts[i - 1][0]
        own = F.col("doc_id").isNull() if first is None else F.col("doc_id") == first
        homes.append(F.when(own, F.struct(F.lit(before).alias("chunk"), F.lit(1).alias("late"))))
    placed = rows.withColumn("home", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull()))).select(
        F.col("home.chunk").alias("chunk"), F.col("home.late").alias("halo"), "doc_id", "text"
    )
    order = Window.partitionBy("chunk").orderBy("halo", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return placed.select("chunk", F.row_number().over(order).alias("place"), "halo", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def _slots(prefix: str) -> Column:
    """Hash of each subset as 8 hex digits; empty for a subset without terms."""
    cells = [F.coalesce(F.right(F.hex(F.col(f"{prefix}{i}")), F.lit(8)), F.lit("")) for i in range(SUBSETS * len(MODULI))]
    return F.array(*cells)


def likeness(a: Column, b: Column) -> Column:
    equal, used, answer = F.lit(0), F.lit(0), None
    for level in reversed(range(len(MODULI))):
        x, y = F.slice(a, level * SUBSETS + 1, SUBSETS), F.slice(b, level * SUBSETS + 1, SUBSETS)
        nx, ny = F.size(F.array_remove(x, "")), F.size(F.array_remove(y, ""))
        same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != "") & (p == q)), lambda t: t))
        count = F.lit(True) if level == len(MODULI) - 1 else F.greatest(nx, ny) <= SPARSE
        equal = equal + F.when(count, same).otherwise(0)
        used = used + F.when(count, nx + ny).otherwise(0)
    answer = F.when(used > 0, 2.0 * equal / used)
    return answer


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = written(lexicon(slim), "imatch-lexicon")
    if words.count() <= BROADCAST:
        words = F.broadcast(words)
    n_chars = F.length("text").cast("bigint")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = with_successor(slim).withColumn("n_chars", n_chars)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    pairs = pairs.withColumn("edited", edited)
    both = pairs.select(
        "chunk", "place", "halo", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))),
    )
    keys = ["chunk", "place", "which", "halo", "doc_id", "n_chars", "edited_sha256", "whole"]
    terms = both.select(*keys[:-1], F.xxhash64("body").alias("whole"), F.explode_outer(F.array_distinct(word_array(F.col("body")))).alias("word"))
    met = terms.withColumn("term", F.xxhash64("word")).join(words, "term", "left")
    sums = [
        F.bit_xor(F.when(F.col(f"s{level}") == j, F.col("term"))).alias(f"x{level * SUBSETS + j}") for level in range(len(MODULI)) for j in range(SUBSETS)
    ]
    # Rows stay in their chunk's partition: the grouping needs no further exchange.
    found = met.groupBy(*keys).agg(*sums)
    slots = _slots("x")
    found = found.select("chunk", "place", "which", "halo", "doc_id", "n_chars", "edited_sha256", "whole", slots.alias("slots"))
    empty = F.size(F.array_remove("slots", "")) == 0
    print_ = F.when(empty, F.concat(F.lit("whole-"), F.lower(F.hex("whole")))).otherwise(F.lower(F.array_join(F.transform("slots", lambda s: F.when(s == "", ".").otherwise(s)), "")))
    found = found.select("chunk", "place", "which", "halo", "doc_id", "n_chars", "edited_sha256", "slots", print_.alias("fingerprint"))
    order = Window.partitionBy("chunk").orderBy("place", "which")
    lined = found.select(
        "*",
        F.lead("fingerprint", 1).over(order).alias("edited_fingerprint"),
        F.lead("slots", 1).over(order).alias("edited_slots"),
        F.lead("fingerprint", 2).over(order).alias("next_fingerprint"),
        F.lead("slots", 2).over(order).alias("next_slots"),
    ).filter("which = 0 AND halo = 0")

    def near(other: str) -> Column:
        equal = (F.col("fingerprint") == F.col(f"{other}_fingerprint")).cast("double")
        return F.when(equal == 1.0, 1.0).otherwise(F.coalesce(likeness(F.col("slots"), F.col(f"{other}_slots")), equal))

    return lined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited").alias("near_edited"), near("next").alias("near_next"))
