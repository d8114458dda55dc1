import json
from decimal import Decimal

from chainweft.sources import files, messages
from pyspark.sql import functions as F


def rows(spark):
    columns = "tx_hash string, block_number long, block_timestamp long, from_addr string, to_addr string, value_wei decimal(38,0), gas long, gas_price long, is_contract_creation boolean, is_contract_call boolean, chain_id int, chain_name string, extra int"
    return spark.createDataFrame([("0xA", 1, 2, "0xs", None, Decimal(10) ** 37, 21000, 9, True, False, 137, " POLYGON-mainnet", 1), ("0xB", 1, 2, "0xs", "0xr", None, None, 9, None, False, 1, None, 1)], columns)


def test_payload_round_trip_and_corrupt_side(spark):
    sent = messages.to_messages(rows(spark))
    assert {(r.topic, r.key) for r in sent.collect()} == {("raw.transactions.polygon", "0xs"), ("raw.transactions.ethereum", "0xs")}
    mixed = sent.select("value").unionByName(spark.createDataFrame([("{broken",), (None,), ('{"gas": "many"}',)], "value string"))
    good, bad = messages.from_messages(mixed)
    assert sorted(map(repr, good.collect())) == sorted(map(repr, rows(spark).drop("extra").collect()))
    assert {r.value for r in bad.collect()} == {"{broken", None, '{"gas": "many"}'}


def test_dead_letters_are_kept_and_replayed(spark, tmp_path):
    letters, out = str(tmp_path / "letters"), str(tmp_path / "out")

    def down(batch):
        raise ConnectionError

    for k in range(3):
        batch = spark.createDataFrame([(10 * k + i, "t", "k", f"m{i}") for i in range(4)], "seq long, topic string, key string, value string")
        assert not messages.deliver(batch, down, letters, most=6)
    kept = lambda: messages.letters(spark, letters)
    assert sorted(r.seq for r in kept().collect()) == [12, 13, 20, 21, 22, 23]
    assert messages.replay(spark, down, letters) == 0
    took = []

    def flaky(batch):
        if len(took) == 2:
            raise ConnectionError
        took.append([r.seq for r in batch.collect()])

    assert messages.replay(spark, flaky, letters, step=2) == 4 and took == [[12, 13], [20, 21]]
    assert sorted(r.seq for r in kept().collect()) == [22, 23]
    (tmp_path / "letters" / "99").mkdir()  # a version that was begun before a crash
    assert messages.replay(spark, lambda b: messages.write_topics(b, out), letters) == 2
    assert spark.read.json(out).count() == 2 and kept().count() == 0
    assert messages.deliver(batch, lambda b: messages.write_topics(b, out), letters)
    assert messages.replay(spark, down, str(tmp_path / "none")) == 0


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("".join(f"{i},{1 if i < 10 else 40}," + ",".join(["0.5"] * 165) + "\n" for i in range(20)))
    (tmp_path / "c.csv").write_text("txId,class\n" + "".join(f"{i},{['1', '2', 'unknown'][i % 3]}\n" for i in range(18)))
    (tmp_path / "e.csv").write_text("txId1,txId2\n1,2\n1,99\n3,4\n")
    rows = files.labelled(files.benchmark_features(spark, str(tmp_path / "f.csv")), files.benchmark_classes(spark, str(tmp_path / "c.csv")))
    assert {r.label: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 8, 1: 6, 2: 6}
    assert {r.split: r["count"] for r in files.chronological(rows).groupBy("split").count().collect()} == {"train": 10, "test": 10}
    assert files.valid_edges(files.benchmark_edges(spark, str(tmp_path / "e.csv")), rows).count() == 2


def test_address_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"addresses": ["0xAB", "0xab", " 0xCd "]}))
    (tmp_path / "b.txt").write_text("# list\n0xEF \n\nnone\n0xab\n")
    (tmp_path / "c.json").write_text(json.dumps([{"address": "0x12"}, {"address": "bc1"}, {"other": 1}]))
    lists = [files.address_json(spark, str(tmp_path / "a.json")), files.address_lines(spark, str(tmp_path / "b.txt")), files.address_entries(spark, str(tmp_path / "c.json"))]
    assert [r.address for r in files.merged_lists(*lists).collect()] == ["0x12", "0xab", "0xcd", "0xef"]
    assert files.address_json(spark, str(tmp_path / "absent.json")).count() == 0


def test_samples_and_chains(spark):
    df = spark.range(10_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "A").otherwise("b").alias("chain_name"))
    got = {r.chain_name: r["count"] for r in files.sampled(df, "id", {"a": 0.25}).groupBy("chain_name").count().collect()}
    assert got["b"] == 5000 and 1100 < got["A"] < 1400
    assert files.by_chain(df, ["a", "b"]).count() == 10_000


def test_node_responses(spark):
    df = spark.createDataFrame([("0x1", "0xa", "0xb", "0x1bc16d674ec80000", "0x5208", "2025-03-01T00:00:00Z")], "hash string, `from` string, `to` string, value string, gas string, time string")
    r = files.raw_transaction(df).first()
    odd = {"0x56bc75e2d63100000": 100 * 10**18, "0x" + "0" * 40 + "f": 15, hex(10**38 - 1): 10**38 - 1, hex(10**38): None, "0x" + "f" * 40: None, "0x": None, "zz": None, None: None, "0x0": 0}
    got = {x.q: x.v for x in spark.createDataFrame([(q,) for q in odd], "q string").select("q", files.quantity(F.col("q")).alias("v")).collect()}
    assert got == odd
    assert (r.value_wei, r.gas, r.block_timestamp) == (2 * 10**18, 21000, 1740787200)


def test_processed_rows_baseline_and_alert_topics(spark, tmp_path):
    df = spark.createDataFrame([(k, k / 10, float(k % 2), "train" if k < 7 else "test") for k in range(10)], "id long, x double, y double, split string")
    files.save_processed(df, str(tmp_path / "p"), "id", ["x", "y"], "y", "split")
    assert {(r.split, r["count"]) for r in spark.read.parquet(str(tmp_path / "p" / "rows")).groupBy("split").count().collect()} == {("train", 7), ("test", 3)}
    assert spark.read.json(str(tmp_path / "p" / "metadata")).first().names == ["x", "y"]
    files.save_baseline(df, "x", str(tmp_path / "b"))
    assert files.baseline(spark, str(tmp_path / "b")).agg(F.sum("n")).first()[0] == 10 and files.baseline(spark, str(tmp_path / "none")).count() == 0
    alerts = spark.createDataFrame([("a", "CRITICAL"), ("b", "MEDIUM"), ("c", None)], "address string, severity string")
    assert {(r.key, r.topic) for r in messages.alert_messages(alerts, "severity", "address", ["address", "severity"]).collect()} == {("a", "alerts.critical"), ("b", "alerts.high"), ("c", "alerts.high")}


def test_alert_store(spark, tmp_path):
    from chainweft.sources.store import AlertStore

    store = AlertStore(spark, str(tmp_path / "s"))
    assert store.rows().count() == 0 and store.recent(3).count() == 0
    make = lambda low: spark.createDataFrame([(k, f"k{k % 3}", ["HIGH", "LOW"][k % 2], 0.5, 1000 * k if k else None) for k in range(low, low + 6)], "n long, key string, severity string, score double, created_at long")
    store.save(make(0), "n")
    store.save(make(6), "n")
    assert sorted(r.id for r in store.rows().collect()) == list(range(1, 13))
    assert [r.id for r in store.recent(2).collect()] == [12, 11] and [r.id for r in store.recent(2, "HIGH").collect()] == [11, 9]
    assert store.history(spark.createDataFrame([("k1",)], "key string")).count() == 4
    assert {(r.severity, r.total, r.last_day) for r in store.statistics(90_000, ["HIGH", "LOW", "CRITICAL"]).collect()} == {("HIGH", 6, 4), ("LOW", 6, 4), ("CRITICAL", 0, 0), (None, 12, 8)}
