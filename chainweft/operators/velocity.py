"""Activity of a sender shortly before each of its rows.

``recent_activity`` looks back by event time. Each sender's rows are cut into buckets as long as the window, and each
bucket is given to the next one as a halo, so that a sender with a large share of all rows is spread over its hours.

``ArrivalHistory`` looks back over what had arrived: a row sees the earlier arrivals of its sender that aren't older
than the window, and drops those that are, for good. That is a sequential fold over one sender's rows between gaps; in
batch they are streamed in order of arrival with no more than the window in memory.

Defined cases: rows without sender or time are left out. Rows of equal time see each other by event time; by arrival
the later one sees the earlier one. Null values count as 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweft.operators.rolling import in_buckets


def recent_activity(rows: DataFrame, entity: str, time: str, order: str, value: str, window_s: int = 3600, burst: int = 20) -> DataFrame:
    """``rows`` with the count and sum over the trailing window, the gap to the row before, and a burst flag.

    The gap is -1 if there was no row within the window. It is a burst from ``burst`` rows on. ``value`` is decimal or
    long.
    """
    known = rows.where((F.length(entity) > 0) & F.col(time).isNotNull())
    spread = in_buckets(known, time, window_s, [c for c in rows.columns if c not in (entity, time, order, value)], "__bucket")
    by = Window.partitionBy(entity, "__bucket")
    trailing = by.orderBy(time).rangeBetween(-window_s, Window.currentRow)
    gap = F.col(time) - F.lag(time).over(by.orderBy(time, order))
    out = spread.select(
        "*",
        F.count(F.lit(1)).over(trailing).alias("tx_count"),
        F.coalesce(F.sum(value).over(trailing), F.lit(0)).alias("value_sum"),
        F.when(gap <= window_s, gap).otherwise(F.lit(-1)).alias("since_last"),
    ).where(~F.col("__halo"))
    return out.withColumn("is_burst", F.col("tx_count") >= burst).drop("__bucket", "__halo")


class ArrivalHistory:
    """One sender's arrivals within the window, in order of time, with their running total in billionths.

    A row takes a search and an insertion into what is held, most of all at its end; rows leave at the front.
    """

    def __init__(self, window_s: float, times: list[float] | None = None, values: list[int] | None = None):
        self.window_s, self.times, self.values = window_s, list(times or []), list(values or [])
        self.gone, self.total = 0, sum(self.values)

    def add(self, time: float, value: float) -> tuple[int, float, float]:
        """(count, sum, gap) as seen by a row that arrives now, itself included."""
        start = bisect_left(self.times, time - self.window_s, self.gone)
        self.total -= sum(self.values[self.gone : start])
        self.gone = start
        if 2 * self.gone > len(self.times) + 64:
            self.times, self.values, self.gone = self.times[self.gone :], self.values[self.gone :], 0
        at = bisect_right(self.times, time, self.gone)
        billionths = round(value * 10**9)
        self.times.insert(at, time), self.values.insert(at, billionths)
        self.total += billionths
        many = len(self.times) - self.gone
        return many, self.total / 10**9, time - self.times[-2] if many > 1 else -1.0

    def held(self) -> tuple[list[float], list[int]]:
        return self.times[self.gone :], self.values[self.gone :]


def arrival_activity(rows: DataFrame, entity: str, time: str, order: str, value: str, window_s: int = 3600) -> DataFrame:
    """(order, tx_count, value_sum, since_last) as seen on arrival; values count to a billionth.

    A sender's rows are cut where one arrives so much later than all before that it finds none of them: what follows
    doesn't depend on what came before, so the pieces are dealt out apart. Only a sender without such a gap is one piece.
    """
    slim = rows.where((F.length(entity) > 0) & F.col(time).isNotNull()).select(F.col(entity).alias("e"), F.col(order).cast("long").alias("o"), F.col(time).cast("double").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    arrived = Window.partitionBy("e").orderBy("o")
    latest = F.max("t").over(arrived.rowsBetween(Window.unboundedPreceding, -1))
    pieces = slim.withColumn("fresh", (F.coalesce(latest, F.lit(float("-inf"))) < F.col("t") - window_s).cast("long")).withColumn("piece", F.sum("fresh").over(arrived.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, history = None, ArrivalHistory(window_s)
        for batch in batches:
            out = []
            for e, piece, o, t, v in batch.itertuples(index=False):
                if (e, piece) != who:
                    who, history = (e, piece), ArrivalHistory(window_s)
                out.append((o, *history.add(t, v)))
            yield pd.DataFrame(out, columns=["o", "tx_count", "value_sum", "since_last"])

    ordered = pieces.select("e", "piece", "o", "t", "v").repartition("e", "piece").sortWithinPartitions("e", "piece", "o")
    return ordered.mapInPandas(run, "o long, tx_count long, value_sum double, since_last double").withColumnRenamed("o", order)
