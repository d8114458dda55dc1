"""Distributions and ranked curves without a global sort in one task.

``running_totals`` is a distributed prefix sum: rows are range-partitioned by key and written, the sums of the
partitions - one row each - give the offset of every partition, and only within a partition are rows added up in
order. Percentiles, cumulative shares, dense numbers and ranked curves are built on it.

Defined cases: null values and NaN take no part in percentiles, shares, histograms and curves. Empty input gives
no rows, or zeros where a row for each class, bin or threshold is due. A null group is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions.scalars import ratio
from chainweft.session import WrittenTables


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys in which null equals null."""
    if not keys:
        return left.crossJoin(right)  # one row without a group
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys))
    return left.join(named, same, how).drop(*(f"__r_{k}" for k in keys))


def running_totals(rows: DataFrame, group: list[str], key: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``upto_V`` for each value V: its sum over the group's rows up to this key, equal keys included.

    (group, key) should be unique.
    """
    laid = rows.repartitionByRange(*(F.col(c) for c in [*group, *key])).withColumn("__part", F.spark_partition_id())
    laid, _ = WrittenTables(rows.sparkSession, "running").write(laid)
    sums = laid.groupBy(*group, "__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition and group that begins or ends in it
    offsets = sums.select(*group, "__part", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy(*group, "__part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _with(laid, offsets, [*group, "__part"])
    return joined.select(*rows.columns, *((F.sum(v).over(within) + F.col(f"__{v}")).alias(f"upto_{v}") for v in values))


def _counted(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative_share(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, share): the share of the group's rows that are no larger than the value."""
    counts = running_totals(_counted(rows, group, value), group, [value], ["n"])
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return _with(counts, totals, group).select(*group, value, (F.col("upto_n") / F.col("total")).alias("share"))


def value_statistics(rows: DataFrame, group: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Count, mean, population deviation, maximum, sum and exact percentiles with linear interpolation, by group."""
    counts = running_totals(_counted(rows, group, value), group, [value], ["n"])
    plain = counts.groupBy(*group).agg(F.sum("n").alias("n"))
    x = F.col(value).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x))
    moments = known.groupBy(*group).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"), F.sum(value).cast("double").alias("sum"))
    placed = _with(counts, plain.withColumnRenamed("n", "total"), group)
    picks = []
    for name, p in ranks.items():
        at = F.lit(p) * (F.col("total") - 1)
        first = F.col("upto_n") - F.col("n")
        low = F.when((first <= F.floor(at)) & (F.floor(at) < F.col("upto_n")), x)
        high = F.when((first <= F.ceil(at)) & (F.ceil(at) < F.col("upto_n")), x)
        part = at - F.floor(at)
        picks.append((F.max(low) + (F.max(high) - F.max(low)) * F.max(part)).alias(name))
    percentiles = placed.groupBy(*group).agg(*picks)
    return _with(_with(moments, plain, group), percentiles, group)


def dense_numbers(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct keys numbered from 0 in their order."""
    ones = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("one", F.lit(1).cast("long"))
    return running_totals(ones, [], [key], ["one"]).select(key, (F.col("upto_one") - 1).alias(name))


def bin_number(value: Column, low: float, high: float, bins: int) -> Column:
    """The equal bin that holds the value, from 0, the last one closed; null outside."""
    step = (high - low) / bins
    number = F.lit(0)
    for k in range(1, bins):
        number = number + (value >= F.lit(round(low + k * step, 12))).cast("int")
    return F.when((value >= low) & (value <= high), number)


def histogram(rows: DataFrame, group: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n), with 0 for empty bins."""
    counts = rows.withColumn("bin", bin_number(F.col(value), low, high, bins)).where(F.col("bin").isNotNull()).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if group else rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return _with(every, counts, [*group, "bin"], "left").select(*group, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def stability_index(rows: DataFrame, is_live: Column, value: str, bins: int = 10, least: float = 1e-6) -> DataFrame:
    """(psi, drift): how far live values have moved from the baseline, over equal bins of [0, 1]."""
    counts = histogram(rows.withColumn("live", F.coalesce(is_live, F.lit(False)).cast("int")).select("live", value), ["live"], value, 0.0, 1.0, bins)
    wide = counts.groupBy("bin").agg(F.sum(F.when(F.col("live") == 0, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("live") == 1, F.col("n")).otherwise(0)).alias("l"))
    totals = wide.agg(F.greatest(F.sum("b"), F.lit(1)).alias("tb"), F.greatest(F.sum("l"), F.lit(1)).alias("tl"))
    b = F.greatest(F.col("b") / totals.select("tb").scalar(), F.lit(least))
    live = F.greatest(F.col("l") / totals.select("tl").scalar(), F.lit(least))
    psi = wide.agg(F.coalesce(F.sum((live - b) * F.log(live / b)), F.lit(0.0)).alias("psi"))
    return psi.select(F.round("psi", 6).alias("psi"), F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("significant").alias("drift"))


def threshold_metrics(rows: DataFrame, score: str, label: Column, thresholds: list[float]) -> DataFrame:
    """The confusion counts and rates at each threshold, from one pass: rows are counted by the step they reach."""
    known = rows.where(F.col(score).isNotNull() & label.isNotNull())
    step = F.lit(0)
    for t in thresholds:
        step = step + (F.col(score) >= F.lit(t)).cast("int")
    counts = known.groupBy(step.alias("step")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    # a row that reaches step k is predicted at the first k thresholds; there are len(thresholds) + 1 steps
    cells = {"tp": ("p", True), "fp": ("n", True), "fn": ("p", False), "tn": ("n", False)}

    def cell(side: str, reached: bool, k: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("step") >= k if reached else F.col("step") < k, F.col(side))), F.lit(0))

    wide = counts.agg(*(cell(*how, k + 1).alias(f"{name}{k}") for k in range(len(thresholds)) for name, how in cells.items()))
    rowed = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{name}{k}").alias(name) for name in cells)) for k, t in enumerate(thresholds)))
    joined = wide.select(F.inline(rowed))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return joined.select(
        "threshold", "tp", "fp", "fn", "tn",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1"),
        F.round(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4).alias("accuracy"),
    )


def ranked_quality(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """(average_precision, roc_auc) with ties of the score taken together."""
    known = rows.where(F.col(score).isNotNull() & label.isNotNull()).select((-F.col(score)).alias("key"), label.alias("y"))
    counts = known.groupBy("key").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    curve = running_totals(counts, [], ["key"], ["p", "n"])
    sums = curve.agg(
        F.sum("p").alias("all_p"), F.sum("n").alias("all_n"),
        F.sum(F.col("p") * F.col("upto_p") / (F.col("upto_p") + F.col("upto_n"))).alias("ap"),
        F.sum(F.col("n") * (F.col("upto_p") - F.col("p") / 2)).alias("area"),
    )
    return sums.select(F.round(ratio(F.col("ap"), F.col("all_p")), 6).alias("average_precision"), F.round(ratio(F.col("area"), F.col("all_p") * F.col("all_n")), 6).alias("roc_auc"))


def best_threshold(metrics: DataFrame) -> DataFrame:
    """The threshold with the best f1, the lowest of several."""
    return metrics.select(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def precision_threshold(rows: DataFrame, score: str, label: Column, wanted: float, default: float = 0.5) -> DataFrame:
    """(threshold): the smallest score at which precision reaches the wanted one, else the default."""
    known = rows.where(F.col(score).isNotNull() & label.isNotNull()).select((-F.col(score)).alias("key"), label.alias("y"))
    counts = known.groupBy("key").agg(F.count_if("y").alias("p"), F.count(F.lit(1)).alias("n"))
    curve = running_totals(counts, [], ["key"], ["p", "n"])
    return curve.where(F.col("upto_p") >= wanted * F.col("upto_n")).agg(F.coalesce(-F.max("key"), F.lit(default)).alias("threshold"))
