from chainweft.operators.skew import lookup


def test_lookup_equals_a_left_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(60)] + [("g", i) for i in range(40)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)] * 20, "k string, v int")
    right = spark.createDataFrame([("h", 1), ("k3", 2), ("z", 3)], "k string, w int")
    want = sorted(map(repr, left.join(right, "k", "left").collect()))
    for hot in (10**6, 50, 1):
        assert sorted(map(repr, lookup(left, right, "k", 150, hot).collect())) == want
    assert lookup(left.limit(0), right, "k", 0, 1).count() == 0
