"""Column expressions for derived transaction fields, vectors and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gwei(wei: Column) -> Column:
    return wei.cast("double") / F.lit(1e9)


def high_value(value_eth: Column, limit: float = 1.0) -> Column:
    return value_eth > F.lit(limit)


def flag(c: Column) -> Column:
    """1.0 where true, 0.0 where false or null."""
    return F.coalesce(c, F.lit(False)).cast("int").cast("double")


def finite(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def pad(vector: Column, width: int) -> Column:
    """The vector with zeros appended up to ``width``; longer ones are cut."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), width)), 1, width)


def unit(vector: Column) -> Column:
    """The vector divided by its length plus 1e-8."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + F.lit(1e-8)
    return F.transform(vector, lambda x: x.cast("double") / length)


def top_by_size(vector: Column, k: int) -> Column:
    """(index, value) of the ``k`` entries of largest absolute value, smaller index first on ties."""
    entries = F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("key"), i.alias("index"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["index"], e["value"]))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns with its keys in order, nulls written, all but ASCII escaped in lower case.

    Meant for text, whole numbers and booleans; other numbers should be given as text, as their forms differ by writer.
    """
    plain = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    plain = F.replace(plain, F.lit("\x7f"), F.lit("\\u007f"))
    pieces = F.regexp_extract_all(plain, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"), F.lit(1))
    lower = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("\\u"), F.lower(x)).otherwise(x)), "")
    return F.when(plain.contains("\\u"), lower).otherwise(plain)


def first_prefix(c: Column, rules: list[tuple[str, int]], default: int) -> Column:
    """The value of the first rule whose prefix the text begins with."""
    out = F.lit(default)
    for prefix, value in reversed(rules):
        out = F.when(c.startswith(prefix), value).otherwise(out)
    return out


def bounded_width(value: Column, scale: float = 2.0, low: float = 1.0, high: float = 5.0) -> Column:
    """A drawing width in proportion to a value, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), value * scale))
