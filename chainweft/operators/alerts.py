"""Alerts by address: one current alert each, updated by later assessments, ranked by a priority that decays.

An assessment is (key, order, at, score, value, label). The first one of a key creates its alert, each later one replaces
the assessment, even by a lower score, and counts as an update. What is kept per key is algebraic, so assessments are
combined in the map tasks and a key that holds most of them sends one state from each.

Defined cases: assessments without a key are none; of equal orders the larger (score, value, label) counts as the later.
A null score or value counts 0 in the priority. Keys in ``acknowledged`` stay acknowledged when they are updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds without decay, and the share that an hour takes after that.
DECAY_AFTER_S, DECAY_RATE = 3600.0, 0.9


def raw_priority(score: Column, value: Column) -> Column:
    """score x ln(value + 2)."""
    return F.coalesce(score, F.lit(0.0)) * F.log1p(F.coalesce(value, F.lit(0.0)) + 1)


def current_alerts(assessments: DataFrame, acknowledged: DataFrame | None = None) -> DataFrame:
    """(key, score, value, label, created_at, updated_at, update_count, acknowledged, raw_priority) of each key."""
    known = assessments.where(F.length("key") > 0)
    last = F.max(F.struct("order", "score", "value", "label", "at")).alias("last")
    state = known.groupBy("key").agg(last, F.min_by("at", "order").alias("created_at"), (F.count(F.lit(1)) - 1).alias("update_count"))
    flat = state.select("key", "last.score", "last.value", "last.label", "created_at", F.col("last.at").alias("updated_at"), "update_count")
    if acknowledged is None:
        flat = flat.withColumn("acknowledged", F.lit(False))
    else:
        flat = flat.join(acknowledged.select("key").distinct().withColumn("__ack", F.lit(True)), "key", "left").withColumn("acknowledged", F.coalesce("__ack", F.lit(False))).drop("__ack")
    return flat.withColumn("raw_priority", raw_priority(F.col("score"), F.col("value")))


def with_priority(alerts: DataFrame, now_s: Column) -> DataFrame:
    """``alerts`` with ``priority``: the raw one, less a tenth for each hour since the update after the first."""
    idle = F.greatest(F.lit(0.0), (now_s - F.col("updated_at") - DECAY_AFTER_S) / 3600.0)
    return alerts.withColumn("priority", F.col("raw_priority") * F.pow(F.lit(DECAY_RATE), idle))


def top_alerts(alerts: DataFrame, now_s: Column, n: int) -> DataFrame:
    """The ``n`` alerts of highest priority that nobody has acknowledged, ties by key."""
    return with_priority(alerts.where(~F.col("acknowledged")), now_s).orderBy(F.desc("priority"), "key").limit(n)


def alert_counts(alerts: DataFrame, labels: list[str]) -> DataFrame:
    """(label, active, created, deduplicated): for each label, also those without any, its active alerts; totals of all."""
    counts = alerts.groupBy("label").agg(F.count_if(~F.col("acknowledged")).alias("active"))
    totals = alerts.agg(F.count(F.lit(1)).alias("created"), F.coalesce(F.sum("update_count"), F.lit(0)).alias("deduplicated"))
    every = alerts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(F.broadcast(counts), "label", "left").crossJoin(totals).select("label", F.coalesce("active", F.lit(0)).alias("active"), "created", "deduplicated")  # one row of totals
