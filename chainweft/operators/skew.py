"""Lookups whose left side may hold a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, or from one part in ``MOST_HOT`` of all rows if that is more.
HOT_ROWS = 500_000
MOST_HOT = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` left-joined with ``right``, which has each ``key`` at most once.

    ``rows`` is the number of rows of ``left``. A key is hot if it holds at least max(hot_rows, rows / MOST_HOT) of
    them, so there are at most ``MOST_HOT`` hot keys whatever the data; only their rows of ``right`` are broadcast,
    and all other keys are joined by a shuffle. Both inputs should be written tables, as they may be read twice.
    Null keys match nothing and take no part in the shuffle.
    """
    extra = [c for c in right.columns if c != key]
    if rows < hot_rows:
        return left.join(right, key, "left")
    least = max(hot_rows, -(-rows // MOST_HOT))
    hot = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema))
    some = F.broadcast(right.join(keys, key, "left_semi"))
    by_broadcast = left.join(keys, key, "left_semi").join(some, key, "left")
    nameless = left.where(F.col(key).isNull())
    for c in extra:
        nameless = nameless.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    by_shuffle = left.where(F.col(key).isNotNull()).join(keys, key, "left_anti").join(right, key, "left")
    return by_broadcast.unionByName(by_shuffle).unionByName(nameless)
