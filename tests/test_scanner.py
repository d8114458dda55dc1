import numpy as np
import pytest

from chainweft.operators import scanner

SOURCES = {
    "reentrancy": 'function withdraw() public {\n  msg.sender.call{value: 1}("");\n  balance -= 1;\n}',
    "two_calls": 'x.call.value(1)(); y.call("");',
    "timestamp": "require(block.timestamp > 5);\nuint t = block.timestamp;",
    "destroy": "function kill() public onlyOwner {\n  selfdestruct(owner);\n}",
    "bare_destroy": "a\n" * 12 + "selfdestruct(owner);",
    "overflow": "pragma solidity ^0.6.0;\ntotal += 1;\nn++;",
    "send": "x.send(1);\nrequire(x.send(1));",
    "safe": "contract Safe {}",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(k, v, "clash") for k, v in SOURCES.items()], "id string, src string, line string")
    return {r.id: r for r in scanner.scan(df, "id", "src").collect()}


def found(r):
    return [(f.rule, f.severity, f.line, f.confidence) for f in r.findings]


def test_rules(scanned):
    assert ("REENTRANCY", "CRITICAL", 2, 0.9) in found(scanned["reentrancy"]) and ("ACCESS_CONTROL", "HIGH", 1, 0.7) in found(scanned["reentrancy"])
    assert found(scanned["two_calls"]) == [("REENTRANCY", "CRITICAL", 1, 0.65)] * 2
    assert found(scanned["timestamp"]) == [("TIMESTAMP_DEPENDENCY", "MEDIUM", 1, 0.8), ("TIMESTAMP_DEPENDENCY", "LOW", 2, 0.8)]
    assert ("SELFDESTRUCT", "LOW", 2, 0.95) in found(scanned["destroy"])
    assert found(scanned["bare_destroy"]) == [("SELFDESTRUCT", "CRITICAL", 13, 0.95)]
    assert found(scanned["overflow"]) == [("INTEGER_OVERFLOW", "HIGH", 2, 0.85)]
    assert found(scanned["send"]) == [("UNCHECKED_RETURN", "MEDIUM", 1, 0.75)]
    assert [found(scanned[k]) for k in ("safe", "empty", "null")] == [[], [], []]


def test_risk(scanned):
    assert scanned["timestamp"].risk == pytest.approx(0.7 * 0.5 + 0.3 * 0.375)
    assert (scanned["safe"].risk, scanned["null"].risk, scanned["null"].lines, scanned["timestamp"].lines) == (0.0, 0.0, 0, 2)


def test_bytecode(spark):
    codes = {"kill": "0x60806040ff6000", "bad": "not_valid_hex!!!", "odd": "0xff5", "push": "60ff", "empty": "", "null": None, "long": "00" * 20001}
    df = spark.createDataFrame(list(codes.items()), "id string, code string")
    out = {r.id: r for r in scanner.bytecode_features(df, "id", "code").collect()}
    assert out["kill"].selfdestruct and out["kill"].risk >= 0.3 and out["kill"].bytes == 7
    assert out["bad"].bytes == out["empty"].bytes == out["null"].bytes == 0
    assert out["odd"].selfdestruct and out["odd"].bytes == 1
    assert not out["push"].selfdestruct
    assert (out["long"].risk, list(out["long"].factors)) == (0.05, ["size"])
    assert all(len(r.vector) == 263 for r in out.values())
    assert np.isclose(out["kill"].vector[0x60], 3 / 7)


def test_opcodes_equal_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        raw = rng.integers(0, 256, rng.integers(0, 90)).astype(np.uint8).tobytes()
        want, at = np.zeros(256, int), 0
        while at < len(raw):
            want[raw[at]] += 1
            at += 1 + max(0, raw[at] - 0x5F if 0x60 <= raw[at] <= 0x7F else 0)
        counts, size = scanner._opcodes("0x" + raw.hex())
        assert counts.tolist() == want.tolist() and size == len(raw)


def test_combined_risk(spark):
    df = spark.createDataFrame([("both", SOURCES["timestamp"], "0xff"), ("source", SOURCES["bare_destroy"], None), ("code", "", "ff"), ("none", None, "")], "id string, src string, code string")
    got = {r.id: (r.source_risk, r.bytecode_risk, r.combined_risk) for r in scanner.scan_contracts(df, "id", "src", "code").collect()}
    assert got["both"] == (pytest.approx(0.4625), 0.3, pytest.approx(0.4625)) and got["source"][1:] == (None, got["source"][0])
    assert got["code"] == (None, 0.3, 0.3) and got["none"] == (None, None, 0.0)
