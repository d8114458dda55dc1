"""Combining several scores of which some may be missing, labels by threshold, decay, and caps on kept rows.

Weights, thresholds and rates are the caller's. Defined cases: a null or negative score is missing; without any score
the combination is 0 and the agreement 0. Ties in a ranking go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(score: Column) -> Column:
    """The score, or null where it is missing."""
    return F.when(score >= 0, score)


def combined(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean of the scores present, weights made to sum to one over those."""
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    top = sum((F.coalesce(present(c) * weights[n], F.lit(0.0)) for n, c in scores.items()), F.lit(0.0))
    whole = sum((F.when(present(c).isNotNull(), weights[n]).otherwise(0.0) for n, c in scores.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(top, whole), F.lit(0.0))


def agreement(scores: list[Column], middle: float = 0.5) -> Column:
    """The share of the scores present that lie on the same side of the middle as their mean."""
    held = F.filter(F.array(*map(present, scores)), lambda x: x.isNotNull())
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)
    side = F.size(F.filter(held, lambda x: (x >= middle) == (mean >= middle)))
    return F.when(F.size(held) > 0, side / F.size(held)).otherwise(F.lit(0.0))


def label(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the highest step that the score reaches."""
    out = F.lit(lowest)
    for least, name in sorted(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def leading(scores: dict[str, Column]) -> Column:
    """The name of the largest score present, the first in the order given on ties."""
    entries = [F.when(present(c).isNotNull(), F.struct((-c).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n"))) for k, (n, c) in enumerate(scores.items())]
    return F.array_min(F.array(*entries))["n"]


def decayed(value: Column, age_s: Column, rate: float, every_s: float, after_s: float) -> Column:
    """The value times ``rate`` for each ``every_s`` by which it is older than ``after_s``."""
    return value * F.pow(F.lit(rate), F.greatest(F.lit(0.0), (age_s - after_s) / every_s))


def kept(rows: DataFrame, protected: Column, rank: Column, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, as far as protected ones allow: those, then the highest ranked."""
    safe = rows.where(F.coalesce(protected, F.lit(False)))
    room = F.greatest(F.lit(0), F.lit(most) - safe.agg(F.count(F.lit(1))).scalar())
    others = rows.where(~F.coalesce(protected, F.lit(False))).orderBy(rank.desc(), key).limit(most)
    place = F.row_number().over(Window.orderBy(rank.desc(), key))  # over at most ``most`` rows
    return safe.unionByName(others.withColumn("__k", place).where(F.col("__k") <= room).drop("__k"))
