import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chainweft.operators.dedup import QuotientTable, first_messages, permute, repeated_messages, unpermute

SCHEMA = "tx_hash string, seq long, seq_clash string, v int"


def test_permutation_is_invertible_and_spreads():
    ids = np.zeros((5000, 4), np.uint64)
    ids[:, 3] = np.arange(5000, dtype=np.uint64)
    assert (unpermute(permute(ids)) == ids).all()
    assert len(np.unique(permute(ids)[:, 0] >> np.uint64(44))) > 4900


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 25), st.integers(-5, 5)), max_size=40), max_size=5))
def test_table_keeps_the_first_of_each(batches):
    table, rows, lost = QuotientTable(16), [], []
    for batch in batches:
        start = len(rows)
        rows += batch
        if batch:
            key = permute(np.array([[0, 0, 0, k] for k, _ in batch], np.uint64))
            order = np.array([o for _, o in batch], np.int64)
            lost += table.insert(key, order, np.zeros_like(order), np.arange(start, len(rows))).tolist()
    kept = table.rows().tolist()
    assert sorted(kept + lost) == list(range(len(rows)))
    best = {}
    for k, o in rows:
        best[k] = min(o, best.get(k, o))
    assert sorted((rows[i][0], rows[i][1]) for i in kept) == sorted(best.items())


def rows(spark):
    a, b = "ab" * 32, "0X" + "AB" * 32
    data = [(a, 5, "x", 1), (b, 3, "y", 2), ("0x" + a, 9, None, None), ("short", 7, "", 0), (" SHORT", 8, "", 0), (None, 1, "", 0), (None, 1, "", 0), ("cd" * 32, 2, "", 0), ("", 4, "", 0), ("0x", 6, "", 0)]
    return spark.createDataFrame(data * 3, SCHEMA)


def test_repeats_and_firsts_partition_the_rows(spark):
    df = rows(spark)
    repeats = sorted(r[0] for r in repeated_messages(df, "tx_hash", "seq").collect())
    firsts = sorted(r[0] for r in first_messages(df, "tx_hash", "seq", ["seq", "v"]).collect())
    assert firsts == [1] * 6 + [2, 3, 4, 7]
    assert sorted(repeats + firsts) == sorted(r.seq for r in df.collect())


def test_empty_tables_and_hot_identifier(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_messages(empty, "tx_hash", "seq").count() == 0
    assert first_messages(empty, "tx_hash", "seq", ["v"]).columns == ["v"]
    hot = spark.range(5000).selectExpr("repeat('ef', 32) AS tx_hash", "id AS seq").repartition(7)
    assert repeated_messages(hot, "tx_hash", "seq").count() == 4999
    assert first_messages(hot, "tx_hash", "seq", ["seq"]).collect()[0][0] == 0


def test_null_order_comes_last(spark):
    df = spark.createDataFrame([("ab" * 32, None), ("ab" * 32, 4)], "tx_hash string, seq long")
    assert [r[0] for r in repeated_messages(df, "tx_hash", "seq").collect()] == [None]


def test_identifiers_of_any_width(spark):
    import hashlib

    digest = hashlib.sha256(b"text:plain").hexdigest()
    names = ["plain", " PLAIN ", "0xplain", "550e8400-e29b-41d4-a716-446655440000", "550E8400-E29B-41D4-A716-446655440000", "z" * 5000]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names * 2)], "id string, k long").repartition(3)
    assert sorted(r[0] for r in first_messages(df, "id", "k", ["k"]).collect()) == [0, 3, 5]
    clash = spark.createDataFrame([("plain", 1), (digest, 2)], "id string, k long").coalesce(1)
    try:
        assert first_messages(clash, "id", "k", ["k"]).count() == 2
    except Exception as error:
        assert "same digest" in str(error)
