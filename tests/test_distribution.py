import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweft.operators import distribution, scoring

RNG = random.Random(5)
VALUES = [("g" if RNG.random() < 0.6 else "h", round(RNG.random(), 2), RNG.random() < 0.3) for _ in range(500)] + [("g", None, True), ("h", float("nan"), False)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(VALUES, "g string, v double, y boolean").repartition(6)


def test_running_totals(spark):
    data = [(g, k, RNG.randrange(9)) for g in "ab" for k in range(200)]
    df = spark.createDataFrame(data, "g string, k long, n long").repartition(5)
    got = {(r.g, r.k): r.upto_n for r in distribution.running_totals(df, ["g"], ["k"], ["n"]).collect()}
    for g in "ab":
        total = 0
        for _, k, n in sorted(x for x in data if x[0] == g):
            total += n
            assert got[g, k] == total


def test_percentiles_equal_numpy(rows):
    got = {r.g: r for r in distribution.value_statistics(rows, ["g"], "v", {"median": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}).collect()}
    for g in "gh":
        x = np.array([v for k, v, _ in VALUES if k == g and v is not None and not math.isnan(v)])
        assert (got[g].n, got[g]["mean"], got[g]["std"]) == (len(x), pytest.approx(x.mean()), pytest.approx(x.std()))
        assert [got[g][c] for c in ("median", "p95", "low", "high")] == pytest.approx(np.quantile(x, [0.5, 0.95, 0, 1]).tolist())


def test_shares_and_numbers(rows):
    x = [v for k, v, _ in VALUES if k == "g" and v is not None and not math.isnan(v)]
    for r in distribution.cumulative_share(rows, ["g"], "v").where("g = 'g'").collect():
        assert r.share == pytest.approx(sum(v <= r.v for v in x) / len(x))
    numbers = {r.g: r.id for r in distribution.dense_numbers(rows, "g", "id").collect()}
    assert numbers == {"g": 0, "h": 1}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 0.3, 0.7, 0.99, 1.0, -0.1, 1.1, None]], "v double")
    assert {r.bin: r.n for r in distribution.histogram(df, [], "v", 0.0, 1.0, 10).collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0, 9: 2}


@pytest.mark.parametrize("shift,drift", [(0.0, "stable"), (0.4, "significant")])
def test_stability_index(spark, shift, drift):
    rng = np.random.default_rng(1)
    base, live = rng.uniform(0, 1, 3000), np.clip(rng.uniform(0, 1, 3000) * (1 - shift) + shift, 0, 1)
    df = spark.createDataFrame([(float(v), False) for v in base] + [(float(v), True) for v in live], "v double, live boolean")
    out = distribution.stability_index(df, F.col("live"), "v").first()
    pct = [np.clip(np.histogram(x, bins=np.linspace(0, 1, 11))[0] / len(x), 1e-6, None) for x in (base, live)]
    assert out.psi == pytest.approx(float(((pct[1] - pct[0]) * np.log(pct[1] / pct[0])).sum()), abs=0.02)
    assert out.drift == drift


def test_thresholds(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.6, True), (0.9, True), (None, True), (0.5, None)], "s double, y boolean")
    m = {r.threshold: r for r in distribution.threshold_metrics(df, "s", F.col("y"), [0.3, 0.5, 0.95]).collect()}
    assert (m[0.5].tp, m[0.5].fp, m[0.5].fn, m[0.5].tn, m[0.5].precision, m[0.5].recall) == (2, 0, 0, 2, 1.0, 1.0)
    assert (m[0.95].precision, m[0.95].f1, m[0.95].fn) == (0.0, 0.0, 2)
    assert distribution.best_threshold(distribution.threshold_metrics(df, "s", F.col("y"), [0.3, 0.5, 0.55])).first().threshold == 0.5
    none = distribution.threshold_metrics(df.limit(0), "s", F.col("y"), [0.5]).first()
    assert (none.tp, none.accuracy) == (0, 0.0)
    assert distribution.precision_threshold(df, "s", F.col("y"), 0.9).first()[0] == 0.6
    assert distribution.precision_threshold(df.where("not y"), "s", F.col("y"), 0.9).first()[0] == 0.5


def test_ranked_quality(rows):
    known = [(v, y) for _, v, y in VALUES if v is not None and not math.isnan(v)]
    out = distribution.ranked_quality(rows.where("not isnan(v)"), "v", F.col("y")).first()
    pos, neg = [v for v, y in known if y], [v for v, y in known if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert out.roc_auc == pytest.approx(auc, abs=1e-6)
    ap = sum(sum(y for v, y in known if v >= t) / sum(v >= t for v, _ in known) * sum(y for v, y in known if v == t) for t in {v for v, _ in known}) / len(pos)
    assert out.average_precision == pytest.approx(ap, abs=1e-6)


def test_combined_scores(spark):
    df = spark.createDataFrame([(0.95, 0.9, 0.85, 0.0), (-1.0, None, -1.0, 0.4), (None, None, None, None), (1.0, 1.0, 1.0, 0.0)], "a double, b double, c double, d double")
    scores = {n: F.col(n) for n in "abcd"}
    weights = {"a": 0.55, "b": 0.25, "c": 0.1, "d": 0.1}
    out = df.select(F.round(scoring.combined(scores, weights), 9).alias("s"), scoring.agreement(list(scores.values())).alias("g"), scoring.leading(scores).alias("top"), scoring.label(scoring.combined(scores, weights), [(0.7, "hot"), (0.3, "warm")], "cold").alias("l")).collect()
    assert [tuple(r) for r in out] == [(0.8325, 0.75, "a", "hot"), (0.4, 1.0, "d", "warm"), (0.0, 0.0, None, "cold"), (0.9, 0.75, "a", "hot")]
    with pytest.raises(ValueError):
        scoring.combined(scores, {"a": 0.5, "b": 0.2, "c": 0.1, "d": 0.1})


def test_decay_and_caps(spark):
    df = spark.createDataFrame([(k, float(k % 7), k < 3) for k in range(20)], "k long, v double, safe boolean")
    out = df.select(scoring.decayed(F.lit(8.0), F.lit(7200.0), 0.5, 3600.0, 3600.0).alias("x"), scoring.decayed(F.lit(8.0), F.lit(60.0), 0.5, 3600.0, 3600.0).alias("y")).first()
    assert tuple(out) == (4.0, 8.0)
    assert sorted(r.k for r in scoring.kept(df, F.col("safe"), F.col("v"), "k", 5).collect()) == [0, 1, 2, 6, 13]
    assert sorted(r.k for r in scoring.kept(df, F.col("safe"), F.col("v"), "k", 2).collect()) == [0, 1, 2]


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    stats = {r.g: (r.n, r.p50, r.max) for r in distribution.value_statistics(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert stats == {"a": (2, 2.0, 3.0), None: (2, 6.0, 7.0)}
    assert {tuple(r) for r in distribution.cumulative_share(df, ["g"], "v").collect()} == {("a", 1.0, 0.5), ("a", 3.0, 1.0), (None, 5.0, 0.5), (None, 7.0, 1.0)}
    assert {tuple(r) for r in distribution.histogram(df, ["g"], "v", 0.0, 8.0, 2).collect()} == {("a", 0, 2), ("a", 1, 0), (None, 0, 0), (None, 1, 2)}
