from collections import defaultdict
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainweft.operators.entity_features import entity_features
from chainweft.operators.heavy_keys import heavy_hitters, per_key
from chainweft.operators.rolling import DAY_S, daily_activity, rolling_totals, trailing_sums

EVENTS = "entity string, type string, time long, value decimal(38,0)"


def test_wide_rows(spark):
    big = Decimal(10) ** 30
    data = [("a", "x", 5, big), ("a", "x", 3, big), ("a", "y", 9, None), ("a", None, 1, big), ("b", "x", None, Decimal(1)), (None, "x", 1, big), ("", "x", 1, big)]
    out = {r.entity: r for r in entity_features(spark.createDataFrame(data * 2, EVENTS)).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"].n, out["a"].total, out["a"].first, out["a"].last) == (8, 6 * big, 1, 9)
    assert {k: tuple(v) for k, v in out["a"].types.items()} == {"x": (4, 4 * big, 3, 5), "y": (2, None, 9, 9)}
    assert (out["b"].n, out["b"].first) == (2, None)
    assert entity_features(spark.createDataFrame([], EVENTS)).count() == 0


def test_wide_rows_shuffle_once(spark):
    plan = entity_features(spark.createDataFrame([("a", "x", 1, Decimal(1))], EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_wide_rows_sort_their_buckets(spark):
    plan = entity_features(spark.createDataFrame([("a", "x", 1, Decimal(1))], EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert "Sort [entity" in plan and plan.index("MapInArrow") < plan.index("Sort [entity") < plan.index("Exchange")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_streamed_runs_against_brute_force(monkeypatch, block):
    from chainweft.operators import entity_features as module

    rng = np.random.default_rng(block)
    kinds = [None, "p", "q", "r"]
    rows = sorted(((f"e{rng.integers(5)}", kinds[rng.integers(4)], int(rng.integers(9)), Decimal(int(rng.integers(-99, 99))) * 10**30 if rng.random() < 0.7 else None, int(rng.integers(99)) if rng.random() < 0.6 else None) for _ in range(200)), key=lambda r: (r[0], r[1] or ""))
    monkeypatch.setattr(module, "MERGE_ROWS", block)
    columns = list(zip(*rows))
    table = pa.table({"entity": columns[0], "type": pa.array(columns[1], pa.string()), "n": columns[2], "total": pa.array(columns[3], pa.decimal128(38, 0)), "first": pa.array(columns[4], pa.int64()), "last": pa.array(columns[4], pa.int64())})
    got = [r for b in module._stream_runs(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert [r["entity"] for r in got] == sorted({r[0] for r in rows})

    def figures(some):
        totals, times = [r[3] for r in some if r[3] is not None], [r[4] for r in some if r[4] is not None]
        return {"n": sum(r[2] for r in some), "total": sum(totals) if totals else None, "first": min(times, default=None), "last": max(times, default=None)}

    for r in got:
        own = [x for x in rows if x[0] == r["entity"]]
        assert {k: r[k] for k in ("n", "total", "first", "last")} == figures(own)
        assert dict(r["types"]) == {k: figures([x for x in own if x[1] == k]) for k in {x[1] for x in own} if k}


def test_heavy_hitters_scan_once(spark, tmp_path):
    spark.createDataFrame([("h", "t")] * 9 + [("i", None)], "f string, t string").write.parquet(str(tmp_path / "k"))
    found = heavy_hitters(spark.read.parquet(str(tmp_path / "k")), {"from": F.col("f"), "to": F.col("t")}, 0.5)
    assert {tuple(r) for r in found.collect()} == {("from", "h", 9), ("to", "t", 9)}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_per_key_and_heavy(spark):
    df = spark.createDataFrame([("h", "t", 1)] * 50 + [(None, "", 2)] * 25 + [(f"k{i}", "t2", None) for i in range(25)], "f string, t string, v int")
    sides = {"from": F.col("f"), "to": F.col("t")}
    out = {(r.side, r.key): (r.rows, r.v) for r in per_key(df, sides, {"v": F.col("v")}).collect()}
    assert out["from", "h"] == (50, 50) and out["from", None] == (25, 50) and out["to", "t2"] == (25, None)
    assert {tuple(r) for r in heavy_hitters(df, sides, 0.25).collect()} == {("from", "h", 50), ("to", "t", 50), ("to", "t2", 25)}
    assert heavy_hitters(df.limit(0), sides, 0.1).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_trailing_sums(values, window):
    got = trailing_sums(np.array([values]), window)[0].tolist()
    assert got == [sum(values[max(0, i - window + 1) : i + 1]) for i in range(len(values))]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_totals_against_brute_force(spark, seed):
    rng, first, days = np.random.default_rng(seed), date(2025, 3, 1), 40
    start = (first - date(1970, 1, 1)).days * DAY_S
    events = [(f"e{rng.integers(3)}", int(start + rng.integers(-2, 42) * DAY_S + rng.choice([0, 1, 3599, 3600, 82800, 86399, int(rng.integers(DAY_S))])), Decimal(int(rng.integers(10**9)) * 10**27)) for _ in range(400)]
    extra = [("e0", None, Decimal(1)), (None, start, Decimal(1)), ("", start, Decimal(1)), ("e1", start + 5, None)]
    df = spark.createDataFrame(events + extra, "entity string, time long, value decimal(38,0)").repartition(5)
    wanted = spark.createDataFrame([("e0",), ("e1",), ("e2",), ("idle",)], "entity string")
    got = {(r.entity, (r.day - first).days): r for r in rolling_totals(daily_activity(df), wanted, first, days).collect()}
    assert len(got) == 4 * days
    by = defaultdict(list)
    for e, t, v in events + extra[3:]:
        by[e].append((t, v or 0))
    for (e, d), r in got.items():
        sent = [(t - start, v) for t, v in by[e] if 0 <= t - start]
        for w in (7, 30):
            inside = [v for t, v in sent if d - w < t // DAY_S <= d]
            assert (r[f"n_{w}d"], r[f"total_{w}d"]) == (len(inside), sum(inside))
        peaks = [sum(t - 3600 <= u <= t for u, _ in ((u - start, v) for u, v in by[e])) for t, _ in sent if t // DAY_S == d]
        assert r.peak == max(peaks, default=0)


def test_rolling_totals_of_nothing(spark):
    none = spark.createDataFrame([], "entity string, time long, value decimal(38,0)")
    assert rolling_totals(daily_activity(none), None, date(2025, 3, 1), 5).count() == 0
