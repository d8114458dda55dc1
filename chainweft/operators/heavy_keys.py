"""Per-key results over skewed keys by map-side combining.

All aggregates are algebraic, so every map task folds its rows into a hash table of mergeable states, which spills by
itself, and only those states are shuffled: a key that holds a third of all rows sends one state from each task.
``groupBy`` with native aggregates plans exactly that.

Defined cases: null keys and empty ones form no group, but their rows count in the total of a side. Empty input gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, sides: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """One row for each side and key: its rows and the sum of each measure, from a single scan.

    ``sides`` names the key of each side; ``measures`` are numeric and null counts as nothing.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(name).alias("side"), key.alias("key")) for name, key in sides.items())))
    rows = df.select(keys.alias("__k"), *(m.alias(n) for n, m in measures.items())).select("__k.*", *measures)
    return rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(n).alias(n) for n in measures))


def heavy_hitters(df: DataFrame, sides: dict[str, Column], share: float) -> DataFrame:
    """(side, key, rows) of the keys that hold at least ``share`` of all rows on their side.

    Every row counts once on each side, null and empty keys included, so the per-key rows add up to the total. Both
    come from one exchange, as neither filter can be moved below the aggregation.
    """
    rows = per_key(df, sides, {})
    total = rows.agg((F.sum("rows") / len(sides)).alias("__total"))
    named = F.when(F.length("key") > 0, F.col("rows")).otherwise(F.lit(-1))
    return rows.where(named >= total.scalar() * share)
