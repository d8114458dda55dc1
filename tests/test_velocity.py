"""Velocity by event time and by arrival, in batch and as a stream."""

from decimal import Decimal

import numpy as np
import pytest

from chainweft.operators.velocity import ArrivalHistory, arrival_activity, recent_activity
from chainweft.plans import models
from chainweft.streaming import pipelines

SCHEMA = "seq long, sender string, block_timestamp long, value_wei decimal(38,0), value_eth double"
T0 = 1_740_787_200


def rows(seed, n=300):
    rng = np.random.default_rng(seed)
    return [(i, f"s{rng.integers(3)}", int(T0 + rng.choice([0, 86400]) + rng.integers(-4000, 4000)), Decimal(int(rng.integers(100))), float(rng.integers(100))) for i in range(n)]


def test_five_in_a_row():
    history = ArrivalHistory(3600)
    assert [history.add(1_000_000 + k, 1.0)[0] for k in range(5)] == [1, 2, 3, 4, 5]
    assert history.add(1_000_004 + 3600, 1.0) == (2, 2.0, 3600.0)
    assert history.add(1_003_604 + 3601, 1.0) == (1, 1.0, -1.0)


@pytest.mark.parametrize("window", [3600, 86400])
def test_recent_activity_equals_brute_force(spark, window):
    data = rows(3)
    df = spark.createDataFrame([*data, (900, None, T0, None, None), (901, "s1", None, None, None)], SCHEMA).repartition(4)
    got = {r.seq: r for r in recent_activity(df, "sender", "block_timestamp", "seq", "value_wei", window, 10).collect()}
    assert len(got) == len(data)
    for i, s, t, v, _ in data:
        mine = [(u, k, w) for k, q, u, w, _ in data if q == s and t - window <= u <= t]
        before = [(u, k) for k, q, u, _, _ in data if q == s and (u, k) < (t, i)]
        gap = t - max(before)[0] if before else None
        r = got[i]
        assert (r.tx_count, r.value_sum, r.is_burst) == (len(mine), sum(w for *_, w in mine), len(mine) >= 10)
        assert r.since_last == (gap if gap is not None and gap <= window else -1)


def test_stream_equals_batch(spark, tmp_path):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    want = {tuple(r) for r in arrival_activity(df, "sender", "block_timestamp", "seq", "value_eth").collect()}
    for k in range(3):
        spark.createDataFrame(data[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (next((tmp_path / f"p{k}").glob("*.parquet"))).rename(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path) + "/[0-9].parquet")
    assert {tuple(r) for r in pipelines.run_to_end(pipelines.velocity(stream)).collect()} == want


def test_many_senders_share_few_groups_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(12)
    data = [(i, f"s{rng.integers(600)}", T0 + i // 500 * 40 * 86400 + int(rng.integers(9000)), None, float(rng.integers(100)) if i % 7 else None) for i in range(2000)]
    data += [(2000 + i, f"s{i % 3}", data[1500][2] + 60 * i, None, 2.5) for i in range(100)]
    df = spark.createDataFrame(data, SCHEMA)
    for k in range(5):
        df.where(f"seq div 500 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    query = pipelines.velocity(stream).writeStream.format("memory").queryName("many_senders").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in arrival_activity(df, "sender", "block_timestamp", "seq", "value_eth").collect()}
    assert {tuple(r) for r in spark.table("many_senders").collect()} == want and len(want) == 2100
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 256


def test_state_of_a_stream_is_cut_by_cores_not_by_the_setting(spark, sf_dir):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        got = models.stream_velocity(spark, sf_dir)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "96"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    batches = {f.rpartition("/")[0] for f in got.inputFiles()}
    assert len(batches) >= 3 and len(got.inputFiles()) <= len(batches) * 2 * spark.sparkContext.defaultParallelism
    assert got.count() == spark.read.parquet(f"{sf_dir}/chain_tx.parquet").where("length(from_addr) > 0").count()


def test_rate_limit(spark, tmp_path):
    calls = [(k, "a" if k % 3 else "b", float(T0 + k)) for k in range(30)] + [(30, "a", float(T0 + 100))]
    df = spark.createDataFrame(calls, "seq long, k string, t double")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "c"))
    got = {r.seq: r.allowed for r in pipelines.run_to_end(pipelines.rate_limited(stream, "k", "t", "seq", 3, 10)).collect()}
    passed = {"a": [], "b": []}
    for s, k, t in calls:
        ok = len([u for u in passed[k] if u > t - 10]) < 3
        assert got[s] == ok
        if ok:
            passed[k].append(t)


def test_windows_sessions_and_scores(spark, tmp_path):
    df = spark.sql(f"SELECT id AS seq, 'x' AS k, timestamp_seconds({T0} + id * 60 + IF(id > 20, 7200, 0)) AS at, id / 100.0D AS score FROM range(40)")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    counts = pipelines.run_to_end(pipelines.windowed_counts(read(), "at", "k", "10 minutes", "1 hour"), "complete")
    assert counts.agg({"n": "sum"}).first()[0] == 40
    runs = sorted(r.n for r in pipelines.run_to_end(pipelines.sessions(read(), "at", "k", "30 minutes", "1 hour"), "complete").collect())
    assert runs == [19, 21]
    last = pipelines.run_to_end(pipelines.last_scores(read(), "k", "seq", "score", "at", 5), "update", ["k"]).collect()
    assert [round(s, 2) for s in last[-1].scores] == [0.35, 0.36, 0.37, 0.38, 0.39]


def parts(df, tmp_path, n=3):
    """The rows as ``n`` files in order."""
    for k in range(n):
        df.where(f"seq % {n} = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "parts"))


def test_results_of_several_micro_batches(spark, tmp_path):
    df = spark.sql(f"SELECT id AS seq, concat('k', id % 2) AS k, timestamp_seconds({T0} + id) AS at, id AS v FROM range(30)")
    whole = pipelines.run_to_end(pipelines.windowed_counts(parts(df, tmp_path / "a"), "at", "k", "1 hour", "1 day"), "complete")
    assert {(r.k, r.n) for r in whole.collect()} == {("k0", 15), ("k1", 15)}
    for mode in ("complete", "update"):
        latest = pipelines.run_to_end(pipelines.latest_state(parts(df, tmp_path / mode), "k", "seq", "v"), mode, ["k"])
        assert {tuple(r) for r in latest.collect()} == {("k0", 28, 14), ("k1", 29, 14)}
    kept = pipelines.run_to_end(pipelines.distinct_messages(parts(df.unionAll(df.selectExpr("seq + 1", "k", "at", "v")).withColumn("name", df["v"].cast("string")), tmp_path / "d"), "name", "at", "1 day"))
    assert kept.count() == 30
    with pytest.raises(ValueError):
        pipelines.run_to_end(parts(df, tmp_path / "u"), "update")


def test_drift_of_the_last_scores(spark, tmp_path):
    rng = np.random.default_rng(5)
    scores = [float(x) for x in rng.beta(2, 5, 400)]
    df = spark.createDataFrame([(i, "m", s) for i, s in enumerate(scores)], "seq long, k string, score double").selectExpr("*", f"timestamp_seconds({T0} + seq) AS at")
    base = (np.histogram(rng.beta(2, 4, 1000), bins=10, range=(0, 1))[0] / 1000).tolist()
    for k in range(3):
        df.where(f"seq div 150 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {r.upto: (r.n, r.psi) for r in pipelines.run_to_end(pipelines.score_drift(stream, "k", "seq", "score", "at", base, 150, 100, 50)).collect()}
    assert sorted(got) == [99, 149, 199, 249, 299, 349, 399]
    for upto, (n, psi) in got.items():
        last = scores[max(0, upto - 149) : upto + 1]
        live = np.maximum(np.histogram(last, bins=10, range=(0, 1))[0] / len(last), 1e-6)
        want = float(np.sum((live - np.maximum(base, 1e-6)) * np.log(live / np.maximum(base, 1e-6))))
        assert n == len(last) and psi == pytest.approx(want)


def test_arrival_history_equals_brute_force():
    rng = np.random.default_rng(9)
    history, held = ArrivalHistory(100), []
    for _ in range(800):
        t, v = float(rng.integers(3000)) if rng.random() < 0.1 else float(len(held) + rng.integers(900)), float(rng.integers(50))
        held = [(u, w) for u, w in [*held, (t, v)] if u >= t - 100]
        times = sorted(u for u, _ in held)
        assert history.add(t, v) == (len(held), sum(w for _, w in held), t - times[-2] if len(times) > 1 else -1.0)


def test_arrivals_are_cut_at_gaps(spark):
    data = rows(6) + [(1000 + i, "s0", T0 + 10 * 86400 * (i // 20) + i, Decimal(1), 1.0) for i in range(100)]
    got = {r.seq: tuple(r)[1:] for r in arrival_activity(spark.createDataFrame(data, SCHEMA).repartition(3), "sender", "block_timestamp", "seq", "value_eth").collect()}
    histories = {}
    for i, s, t, _, v in data:
        assert got[i] == histories.setdefault(s, ArrivalHistory(3600)).add(float(t), v)


def test_messages_are_consumed_at_least_once(spark, tmp_path):
    from chainweft.sources import messages

    values = [('{"tx_hash": "0x%d", "gas": %d}' % (k, k), k) for k in range(9)] + [("{broken", 9), (None, 10)]
    df = spark.createDataFrame(values, "value string, seq long")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m" / "parts"))
    parts(df, tmp_path / "m")
    good, bad, fails = [], [], [1]

    def handle(batch):
        if len(good) >= 3 and fails:
            fails.pop()
            raise ConnectionError
        good.extend(r.gas for r in batch.collect())

    run = lambda: pipelines.consume(stream(), handle, lambda b: bad.extend(r.value for r in b.collect()), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception):
        run().awaitTermination()
    assert len(good) == 3
    run().awaitTermination()
    assert sorted(good) == list(range(9)) and set(bad) == {"{broken", None} and messages.PAYLOAD
