import random

import pytest

from chainweft.llm.groups import connected_groups

SCHEMA = "x string, y string, label string, member int"


def brute(pairs):
    root = {}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(root.setdefault(a, a) and a), find(root.setdefault(b, b) and b)))
            root[b] = a
    return {v: find(v) for v in root}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "hub_last"])
def test_groups_equal_union_find(spark, shape):
    rng = random.Random(shape)
    names = [f"{rng.randrange(10**6):06d}" for _ in range(300)]
    pairs = {
        "chain": list(zip(sorted(names), sorted(names)[1:])),
        "star": [(names[0], n) for n in names],
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(230)],
        "hub_last": [("zzz", n) for n in names] + [("q", "p")],
    }[shape]
    pairs += [(None, "a"), ("b", None), ("c", "c"), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in pairs], SCHEMA)
    assert {r.member: r.label for r in connected_groups(df, "x", "y").collect()} == brute(pairs)


def test_no_pairs(spark):
    assert connected_groups(spark.createDataFrame([], SCHEMA), "x", "y").count() == 0
