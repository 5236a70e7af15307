import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns of the input whose names operators could use themselves.
        T.StructField("anchor", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("key", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

LONG = " ".join(f"w{i * i % 977}" for i in range(9000))
STORY = " ".join(f"tale{i}" for i in range(40))
ODD = [
    (1, STORY + " and its end", "en", "a"),
    (2, STORY + " and its end", "en", "a"),  # a copy
    (3, "a new start \t\n" + STORY, "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "en", "ä"),
    (7, LONG, "en", "a"),
    (8, LONG + " tail", "en", None),
    (9, "one two", "de", "z"),
    (9, "one two", "de", "z"),  # a repeated row
    (10, "one two three", "de", "z"),
    (10, "other text under the same id", "de", "z"),
    (None, STORY, None, None),
    (None, None, None, None),
    (2**40, "zwölf Wörter ▁ mit <s> und 𝔘nicode", "de", "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "x", 0.5, None, 7) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 11)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
