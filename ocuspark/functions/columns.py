"""Small column expressions shared by the operators (all stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null (least/greatest skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def r6(c) -> Column:
    return F.round(col(c), 6)


def safe_div(num, den, default=None) -> Column:
    """num / den where den is positive, otherwise the default."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(default).cast("double"))


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def lookup(c, table: dict, default) -> Column:
    """Constant dictionary lookup as a literal map; unknown key -> default."""
    pairs = []
    for key, value in table.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(default))


def as_bool(c, default: bool = False) -> Column:
    """Lenient boolean parsing: 1 / true / yes / on, any case, blanks trimmed."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin("1", "true", "yes", "on"), F.lit(default))


def clamp_count(c, low: int = 1, high: int = 500, default: int = 100) -> Column:
    """Bound a run-count parameter; missing or unparsable -> default."""
    n = F.coalesce(F.expr("try_cast(%s as bigint)" % c) if isinstance(c, str) else c, F.lit(default))
    return F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("bigint")


def parse_schedule(c, default=(1, 10, 100), max_len: int = 50) -> Column:
    """Comma list -> sorted distinct integers >= 1.

    Blank input gives the default. A list with a bad entry, an entry below 1 or
    more than ``max_len`` entries is rejected as a whole (null), as a caller
    would be told about an invalid request.
    """
    c = col(c)
    parts = F.filter(F.split(c, ","), lambda p: F.trim(p) != "")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("int"))
    bad = F.exists(numbers, lambda n: n.isNull() | (n < 1))
    valid = ~bad & (F.size(numbers) <= max_len) & (F.size(numbers) > 0)
    blank = c.isNull() | (c == "")
    return F.when(blank, F.array(*[F.lit(int(v)) for v in default])).when(
        valid, F.array_sort(F.array_distinct(numbers))
    )
