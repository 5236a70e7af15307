"""Registry of named queries and their twins for the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocuspark.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Lazy access to the domain tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    def elements_by_screen(self) -> DataFrame:
        """The elements, those of a screen together: they can be numbered and grouped by screen without another shuffle."""
        return adapters.table(self.spark, self.sf_dir, "elements", dealt={"lineitem": "l_orderkey"})

    def elements_of(self, screens: DataFrame) -> DataFrame:
        """The elements of the given screens (screen_id); the others are neither shuffled nor numbered."""
        wanted = screens.select(F.col("screen_id").alias("l_orderkey"))
        return adapters.table(self.spark, self.sf_dir, "elements", only={"lineitem": wanted})


def query(name: str, check: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` and, if given, its SQL twin.

    ``tables`` lists the domain tables the SQL refers to by name; they are put
    in front as common table expressions.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if check is not None:
            heads = [f"{t} AS ({adapters.check_sql(t)})" for t in tables]
            body = check.strip()
            if body.startswith("WITH "):
                word = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
                CHECKS[name] = word + ",\n".join([*heads, body[len(word):]])
            elif heads:
                CHECKS[name] = "WITH " + ",\n".join(heads) + "\n" + body
            else:
                CHECKS[name] = body
        return fn

    return register
