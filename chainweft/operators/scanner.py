"""Rule scan of contract source, line by line, and features of bytecode.

Source rules are array expressions over the lines of one text, so the scan is a projection without a shuffle. Contexts
are the lines after or before a line. Operands in bytecode are swallowed by one pattern in Arrow batches, and what is
left is counted.

Defined cases: null and empty texts have no findings. Lines end with a line feed. Bytecode that isn't hexadecimal has
length 0 and no features; an odd last digit is ignored; null counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of risky source code and of what protects it.
CALLS = [r"\.call\.value\s*\(", r"\.call\{value\s*:", r"\.call\s*\(\s*\"\"\s*\)"]
STATE_UPDATE = r"(balances|balance|amount|state)\s*[\-\+]?="
TIMESTAMP = r"block\.timestamp"
CRITICAL_USE = r"(require|if|random|seed|lottery|winner)"
OPEN_FUNCTION = r"function\s+(\w+)\s*\([^)]*\)\s*(public|external)"
UNNAMED = ["constructor", "fallback", "receive"]
PROTECTED = r"onlyOwner|onlyAdmin|onlyRole|require\s*\(\s*msg\.sender|modifier"
STATE_CHANGE = r"=\s*[^=]|\+=|-=|\*=|\.push\(|delete\s+"
OLD_COMPILER = r"pragma\s+solidity\s+[\^~]?0\.[0-7]\."
ARITHMETIC = r"[\+\-\*\/]=|\+\+|--"
SEND = r"\.(transfer|send)\s*\("
CHECKED = r"require|assert"
DESTROY = r"selfdestruct\s*\("
OWNER_ONLY = r"onlyOwner|require\s*\(\s*msg\.sender"
# Scores of severities.
SEVERITY = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.5, "LOW": 0.25, "INFO": 0.1}
# Opcodes.
PUSH_FIRST, PUSH_LAST, CALL, DELEGATECALL, SELFDESTRUCT, TIMESTAMP_OP, SSTORE, SLOAD = 0x60, 0x7F, 0xF1, 0xF4, 0xFF, 0x42, 0x55, 0x54


def findings(text: Column) -> Column:
    """Array of (rule, severity, line, confidence) for a source text, in order of rule and line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def after(i: Column, n: int) -> Column:
        return F.array_join(F.slice(lines, i + 2, n), "\n")

    def before(i: Column, n: int) -> Column:
        start = F.greatest(i - (n - 1), F.lit(0))
        return F.array_join(F.slice(lines, start + 1, i - start + 1), "\n")

    def rule(name: str, holds: Callable[[Column, Column], Column], severity: Callable[[Column, Column], Column], confidence: Callable[[Column, Column], Column]) -> Column:
        found = F.transform(lines, lambda x, i: F.when(holds(x, i), F.struct(F.lit(name).alias("rule"), severity(x, i).alias("severity"), (i + 1).alias("line"), confidence(x, i).alias("confidence"))))
        return F.filter(found, lambda f: f.isNotNull())

    always = lambda value: lambda x, i: F.lit(value)
    name = lambda x: F.regexp_extract(x, OPEN_FUNCTION, 1)
    rules = [rule("REENTRANCY", lambda x, i, p=p: x.rlike(p), always("CRITICAL"), lambda x, i: F.when(after(i, 5).rlike(STATE_UPDATE), 0.9).otherwise(0.65)) for p in CALLS]
    rules += [
        rule("TIMESTAMP_DEPENDENCY", lambda x, i: x.rlike(TIMESTAMP), lambda x, i: F.when(x.rlike(CRITICAL_USE), "MEDIUM").otherwise("LOW"), always(0.8)),
        rule("ACCESS_CONTROL", lambda x, i: x.rlike(OPEN_FUNCTION) & ~name(x).isin(UNNAMED) & after(i, 20).rlike(STATE_CHANGE) & ~after(i, 20).rlike(PROTECTED), always("HIGH"), always(0.7)),
        F.when(text.rlike(OLD_COMPILER) & ~text.contains("SafeMath"), F.slice(rule("INTEGER_OVERFLOW", lambda x, i: x.rlike(ARITHMETIC), always("HIGH"), always(0.85)), 1, 1)),
        rule("UNCHECKED_RETURN", lambda x, i: x.rlike(SEND) & ~x.rlike(CHECKED), always("MEDIUM"), always(0.75)),
        rule("SELFDESTRUCT", lambda x, i: x.rlike(DESTROY), lambda x, i: F.when(before(i, 10).rlike(OWNER_ONLY), "LOW").otherwise("CRITICAL"), always(0.95)),
    ]
    return F.when(F.length(text) > 0, F.flatten(F.filter(F.array(*rules), lambda a: a.isNotNull()))).otherwise(F.array().cast("array<struct<rule:string,severity:string,line:int,confidence:double>>"))


def severity_score(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[severity]


def scan_risk(found: Column) -> Column:
    """0.7 of the worst severity and 0.3 of the mean one; 0 without findings."""
    scores = F.transform(found, lambda f: severity_score(f["severity"]))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) > 0, 0.7 * F.array_max(scores) + 0.3 * mean).otherwise(F.lit(0.0))


def scan(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, findings, risk, lines) of each text."""
    return texts.select(ident, findings(F.col(text)).alias("findings"), F.when(F.length(text) > 0, F.size(F.split(F.col(text), "\n", -1))).otherwise(0).alias("lines")).withColumn("risk", scan_risk(F.col("findings")))


#: A push instruction, its opcode in a group, with as much of its operand as there is.
_PUSH = re.compile(b"|".join(b"(%b)[\\s\\S]{0,%d}" % (re.escape(bytes([PUSH_FIRST + n])), n + 1) for n in range(PUSH_LAST - PUSH_FIRST + 1)))
_OPCODE = b"".join(b"\\g<%d>" % (n + 1) for n in range(PUSH_LAST - PUSH_FIRST + 1))


def _opcodes(code: str | None) -> tuple[np.ndarray, int]:
    """Counts of the opcodes of a bytecode, operands left out, and its length in bytes."""
    digits = re.sub("0x| ", "", code or "")
    try:
        raw = bytes.fromhex(digits[: len(digits) & ~1])
    except ValueError:
        raw = b""
    return np.bincount(np.frombuffer(_PUSH.sub(_OPCODE, raw), np.uint8), minlength=256).astype(np.int32), len(raw)


def opcode_counts(code: Column) -> Column:
    """(counts of the 256 opcodes, length in bytes) of hexadecimal bytecode."""

    @F.pandas_udf("struct<counts: array<int>, bytes: int>")
    def walk(codes: pd.Series) -> pd.DataFrame:
        known = {c: _opcodes(c) for c in codes.unique()}
        return pd.DataFrame({"counts": [known[c][0] for c in codes], "bytes": [known[c][1] for c in codes]})

    return walk(code)


def _figures() -> dict[str, Column]:
    """Frequencies and flags from ``counts`` and ``bytes``."""
    count = lambda op: F.element_at("counts", op + 1)
    total = F.greatest("bytes", F.lit(1))
    frequencies = {"call_frequency": count(CALL) / total, "sstore_frequency": count(SSTORE) / total, "sload_frequency": count(SLOAD) / total}
    return frequencies | {"selfdestruct": count(SELFDESTRUCT) > 0, "timestamp": count(TIMESTAMP_OP) > 0, "delegatecall": count(DELEGATECALL) > 0}


def _signs() -> tuple[Column, Column]:
    """The risk of a bytecode and the names of the signs that make it up."""
    f = _figures()
    # Weights and limits of the signs.
    signs = [("selfdestruct", f["selfdestruct"], 0.30), ("delegatecall", f["delegatecall"], 0.25), ("call_frequency", f["call_frequency"] > 0.02, 0.20), ("timestamp", f["timestamp"], 0.10), ("sstore_frequency", f["sstore_frequency"] > 0.05, 0.10), ("size", F.col("bytes") > 20000, 0.05)]
    risk = reduce(lambda a, b: a + b, (F.when(holds, weight).otherwise(0.0) for _, holds, weight in signs))
    factors = F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds, _ in signs)), lambda x: x.isNotNull())
    return F.round(F.least(F.lit(1.0), risk), 4), factors


def bytecode_features(codes: DataFrame, ident: str, code: str) -> DataFrame:
    """(ident, bytes, frequencies and flags, risk, factors, vector of 263) of each bytecode."""
    flat = codes.select(ident, opcode_counts(F.col(code)).alias("w")).select(ident, "w.*")
    risk, factors = _signs()
    named = _figures()
    order = ["call_frequency", "sstore_frequency", "sload_frequency", "selfdestruct", "timestamp", "delegatecall"]
    extras = [named[c].cast("double") for c in order] + [F.col("bytes").cast("double")]
    vector = F.concat(F.transform("counts", lambda c: c / F.greatest(F.col("bytes"), F.lit(1))), F.array(*extras))
    return flat.select(ident, "bytes", *(named[c].alias(c) for c in order), risk.alias("risk"), factors.alias("factors"), vector.alias("vector"))


def scan_contracts(contracts: DataFrame, ident: str, source: str, code: str) -> DataFrame:
    """(ident, source_risk, bytecode_risk, combined_risk): the larger of the risks of what there is, 0 without either.

    A null or empty source or bytecode is none. The rows of one identifier are one contract and should be one row.
    """
    here = contracts.select(F.col(ident), F.col(source).alias("__source"), F.col(code).alias("__code"))
    one = here.withColumn("__findings", findings(F.col("__source"))).withColumn("source_risk", F.when(F.length("__source") > 0, scan_risk(F.col("__findings"))))
    two = one.withColumn("__w", opcode_counts(F.col("__code"))).select(ident, "source_risk", F.length("__code").alias("__length"), "__w.*")
    risk, _ = _signs()
    both = two.withColumn("bytecode_risk", F.when(F.col("__length") > 0, risk))
    return both.select(ident, "source_risk", "bytecode_risk", F.coalesce(F.greatest("source_risk", "bytecode_risk"), F.lit(0.0)).alias("combined_risk"))
