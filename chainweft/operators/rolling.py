"""Rolling totals over trailing periods, with days without activity, and the busiest hour of each day.

Trailing totals use block decomposition: days are cut into blocks as long as the window; with prefix sums from each
block's start and suffix sums to each block's end, the total of any window is the suffix of the block it begins in
plus the prefix of the block it ends in. That is one addition for each day and window, however long the window.

Trailing-hour counts look back one hour only, so each entity's time line is cut into buckets as long as that, and each
bucket's rows are also given to the next one as a halo. An entity that holds a large share of all rows is thereby
spread over its active hours; after that only one compact row for each entity, day and task is shuffled.

Defined cases: null or empty entities and rows without a time have no totals. A null value counts as nothing, its row
still as one. Rows with equal time see each other. Days outside the calendar, and a window's days before it, are empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.operators.decimals import LIMBS, decimals, limbs

DAY_S = 86400


def in_buckets(rows: DataFrame, time: str, length_s: int, carried: list[str], bucket: str) -> DataFrame:
    """``rows`` with the bucket of ``length_s`` seconds that holds each, and once more, marked ``__halo``, for the next.

    A row's trailing window of that length then lies within its own bucket and the halo. Halo rows leave the
    ``carried`` columns null, as nothing reads them there.
    """
    own = F.floor(F.col(time) / F.lit(length_s))
    places = F.array(F.struct(own.alias(bucket), F.lit(False).alias("__halo")), F.struct((own + 1).alias(bucket), F.lit(True).alias("__halo")))
    twice = rows.withColumn("__place", F.explode(places)).select(*rows.columns, "__place.*")
    return twice.withColumns({c: F.when(~F.col("__halo"), F.col(c)) for c in carried})


def daily_activity(events: DataFrame, lookback_s: int = 3600) -> DataFrame:
    """(entity, day, n, total, peak) for each entity and active day.

    ``events`` is (entity string, time long in epoch seconds, value decimal(38,0)); ``day`` counts days since the
    epoch; ``peak`` is the largest number of the entity's rows in the ``lookback_s`` seconds up to one of the day's
    rows, both ends included.
    """
    known = events.where((F.length("entity") > 0) & F.col("time").isNotNull()).select("entity", "time", "value")
    rows = in_buckets(known, "time", lookback_s, ["value"], "bucket")
    trailing = Window.partitionBy("entity", "bucket").orderBy("time").rangeBetween(-lookback_s, Window.currentRow)
    counted = rows.withColumn("recent", F.count(F.lit(1)).over(trailing)).where(~F.col("__halo"))
    return counted.groupBy("entity", F.floor(F.col("time") / F.lit(DAY_S)).cast("int").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast(T.DecimalType(38, 0)).alias("total"), F.max("recent").alias("peak")
    )


def trailing_sums(values: np.ndarray, window: int) -> np.ndarray:
    """Sums over the last ``window`` entries along axis 1 by block decomposition; earlier entries are empty."""
    rows, length = values.shape[:2]
    blocks = -(-length // window)
    padded = np.zeros((rows, blocks * window, *values.shape[2:]), values.dtype)
    padded[:, :length] = values
    cut = padded.reshape(rows, blocks, window, *values.shape[2:])
    prefix = cut.cumsum(axis=2).reshape(padded.shape)[:, :length]
    suffix = cut[:, :, ::-1].cumsum(axis=2)[:, :, ::-1].reshape(padded.shape)[:, :length]
    out = prefix.copy()
    # the window ending at d begins at d - window + 1; unless that starts a block, it lies in the block before d's
    ends = np.arange(length)
    begins = ends - window + 1
    split = (begins > 0) & (begins % window != 0)
    out[:, ends[split]] += suffix[:, begins[split]]
    head = (begins <= 0) & (ends >= window)  # none: a window that begins before the calendar ends in block 0
    assert not head.any()
    return out


def _spread(windows: Sequence[int], first_day: int, days: int):
    """Lays the active days of each entity on the calendar and emits every day with its trailing totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                many, active = batch.num_rows, batch["active"]
                lengths = np.diff(np.asarray(active.offsets))
                flat = active.flatten()
                row = np.repeat(np.arange(many), lengths)
                day = flat.field("day").to_numpy(zero_copy_only=False) - first_day
                inside = (day >= 0) & (day < days)
                place = (row[inside], day[inside])
                n, peak = np.zeros((many, days), np.int64), np.zeros((many, days), np.int64)
                total = np.zeros((many, days, LIMBS), np.int64)
                n[place] = flat.field("n").to_numpy(zero_copy_only=False)[inside]
                peak[place] = flat.field("peak").to_numpy(zero_copy_only=False)[inside]
                total[place] = limbs(flat.field("total"))[inside]
                out = {
                    "entity": batch["entity"].take(pa.array(np.repeat(np.arange(many), days))),
                    "day": pa.array(np.tile(np.arange(first_day, first_day + days, dtype=np.int32), many)),
                }
                for w in windows:
                    out[f"n_{w}d"] = pa.array(trailing_sums(n, w).ravel())
                    out[f"total_{w}d"] = decimals(trailing_sums(total, w))
                out["peak"] = pa.array(peak.ravel())
                yield pa.record_batch(out)

    return run


def rolling_totals(daily: DataFrame, entities: DataFrame | None, first_day: date, days: int, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals for each entity and each calendar day, active or not.

    ``daily`` comes from ``daily_activity``. ``entities`` (entity) lists those wanted, also without any activity; None
    takes all of ``daily``. Returns (entity, day date, n_Wd, total_Wd for each window of W days, peak).
    """
    start = (first_day - date(1970, 1, 1)).days
    active = daily.where(F.col("day").between(start, start + days - 1)).groupBy("entity").agg(F.collect_list(F.struct("day", "n", "total", "peak")).alias("active"))
    if entities is not None:
        active = entities.join(active, "entity", "left").withColumn("active", F.coalesce("active", F.array().cast(active.schema["active"].dataType)))
    schema = "entity string, day int, " + "".join(f"n_{w}d long, total_{w}d decimal(38,0), " for w in windows) + "peak long"
    spread = active.select("entity", "active").mapInArrow(_spread(windows, start, days), schema)
    return spread.withColumn("day", F.date_from_unix_date("day"))
