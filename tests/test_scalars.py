import json
import hashlib
import math

from pyspark.sql import functions as F

from chainweft.functions import identity, scalars


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.5], 1), ([], 2)], "v array<double>, k int")
    out = {r.k: r for r in df.select("k", scalars.pad(F.col("v"), 4).alias("p"), scalars.unit(F.col("v")).alias("u"), scalars.top_by_size(F.col("v"), 2).alias("t")).collect()}
    assert list(out[1].p) == [3.0, -4.0, 0.5, 0.0] and list(out[2].p) == [0.0] * 4
    assert math.isclose(sum(x * x for x in out[1].u), 1, rel_tol=1e-6) and list(out[2].u) == []
    assert [(e["index"], e["value"]) for e in out[1].t] == [(1, -4.0), (0, 3.0)]


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(scalars.finite(F.col("x"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    r = spark.range(1).select(scalars.ratio(F.lit(1), F.lit(0)), scalars.high_value(F.lit(1.0)), scalars.gwei(F.lit(5_000_000_000)), scalars.flag(F.lit(None).cast("boolean"))).first()
    assert tuple(r) == (0.0, False, 5.0, 0.0)


def test_identity(spark):
    df = spark.createDataFrame([("0xA9059cBB0000", "0XAb", None), ("0x", "", "x"), (None, None, "ab" * 32), ("", " 0xCD ", "0x" + "AB" * 32)], "i string, a string, h string")
    out = df.select(identity.event_type(F.col("i")), identity.input_bytes(F.col("i")), identity.address(F.col("a")), F.length(identity.fixed_id(F.col("h")))).collect()
    assert [tuple(r) for r in out] == [("0xa9059cbb", 6, "0xab", None), ("0x", 0, None, None), ("0x", 0, None, 32), ("0x", 0, "0xcd", 32)]


def test_canonical_json(spark):
    rows = [(2, "x", None), (None, 'a"b\\c\n\t/ \u00e9 \u20ac \U0001f600 \x1f \x7f', "\\u00E9 stays"), (-5, "", "ж")]
    df = spark.createDataFrame(rows, "b int, a string, c string")
    got = [r[0] for r in df.select(scalars.canonical_json(["b", "a", "c"])).collect()]
    assert got == [json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, separators=(",", ":")) for b, a, c in rows]


def test_rules_by_prefix(spark):
    df = spark.createDataFrame([("/scan/x",), ("/scanner",), ("/graph/1",), (None,)], "p string")
    assert [r[0] for r in df.select(scalars.first_prefix(F.col("p"), [("/scan/", 1), ("/scan", 2)], 9)).collect()] == [1, 2, 9, 9]
    assert spark.range(1).select(scalars.bounded_width(F.lit(0.1)), scalars.bounded_width(F.lit(9.0))).first() == (1.0, 5.0)
