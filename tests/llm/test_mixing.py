import random
from collections import Counter

import pytest

from chainweft.llm.mixing import budgets, draw, plan_mix, reached_shares, share_out, with_tokens
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, tokens int"


def split(amount, weights, supplies):
    """Splits an amount by weights, round by round: whoever is full leaves the round."""
    given, open_parts = [0.0] * len(weights), {k for k, w in enumerate(weights) if w > 0}
    while open_parts and amount > 1e-9:
        total = sum(weights[k] for k in open_parts)
        full = {k for k in open_parts if given[k] + amount * weights[k] / total >= supplies[k]}
        for k in full or open_parts:
            step = supplies[k] - given[k] if full else amount * weights[k] / total
            given[k] += step
        if not full:
            break
        amount -= sum(supplies[k] for k in full)
        open_parts -= full
    return given


def test_share_out_equals_rounds(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for parent in range(60):
        many, amount = rng.randrange(1, 7), rng.choice([0.0, 50.0, 100.0, 1000.0])
        weights = [rng.choice([0.0, 0.1, 0.2, 0.5]) for _ in range(many)]
        supplies = [float(rng.choice([0, 5, 20, 100, 500])) for _ in range(many)]
        rows += [(parent, f"c{k}", weights[k], supplies[k], amount) for k in range(many)]
        want |= {(parent, f"c{k}"): g for k, g in enumerate(split(amount, weights, supplies))}
    got = share_out(spark.createDataFrame(rows, "parent int, name string, weight double, supply double, amount double"), ["parent"], "name").collect()
    assert {(r.parent, r.name): r.given for r in got} == pytest.approx(want)


def test_siblings_come_before_ancestors(spark):
    rows = [("x", "en", 0.25, 10.0), ("x", "de", 0.25, 1000.0), ("y", "en", 0.3, 1000.0), ("z", "en", 0.2, 10.0)]
    leaves = spark.createDataFrame([(*r, r[2] * 200) for r in rows], "a string, b string, weight double, supply double, entitled double")
    got = {(r.a, r.b): r.budget for r in budgets(leaves, ["a", "b"]).collect()}
    # what (x, en) lacks stays in x; what z lacks goes to x and y by 5 to 3
    assert got == pytest.approx({("x", "en"): 10, ("x", "de"): 108.75, ("y", "en"): 71.25, ("z", "en"): 10})


def texts(rng, n):
    return " ".join(rng.choice(["ether", "wallet", "Łódź", "0xabc"]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(k, texts(rng, rng.randrange(1, 60)), rng.choice(["en", " DE", None]), rng.choice(["big", "BIG ", "small-one", "Small One", "other"] if k % 3 else ["big"]), 0) for k in range(900)]
    rows += [(900, None, None, "big", 0), (901, "", "en", "small_one", 0), (902, "x" * 200_000, "en", "big", 0), (3, "again", "en", "big", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    targets = spark.createDataFrame([("big", 0.3, 1), ("small_one", 0.6, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    return docs, plan_mix(docs.drop("tokens"), "doc_id", "text", F.col("source"), targets, {"language": F.lower(F.substring(F.trim("lang"), 1, 2))})


def test_shares_and_shortage(mixed):
    _, mix = mixed
    out = {r.source: r for r in reached_shares(mix).collect()}
    assert {k: r.short for k, r in out.items()} == {"big": False, "small_one": False if out["small_one"].size * 2 >= 0.6 * sum(r.size for r in out.values()) else True, "absent": True}
    for r in out.values():
        assert r.tokens <= r.budget + 1 and r.tokens <= r.max_repeats * r.size
    assert sum(r.budget for r in out.values()) <= sum(r.size for r in out.values()) + 1
    assert sum(r.reached_share for r in out.values()) == pytest.approx(1, abs=1e-5)


def test_draw_is_repeatable_and_caps_repeats(mixed):
    _, mix = mixed
    one, two, other = (Counter({(r.id, r.source, r.tokens): r.copies for r in draw(mix, seed).collect()}) for seed in (1, 1, 2))
    assert one == two != other
    assert all(n <= (1 if k[1] == "big" else 2) for k, n in one.items())
    assert max(n for k, n in one.items() if k[1] == "small_one") == 2


def test_tokens_equal_another_library(spark):
    from tokenizers import Tokenizer

    texts = ["tx sent to 0xabc, 12.5 ETH", "", None, "Łódź – naïve  \n\n rows", "<|endoftext|>"]
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    want = {k: len(other.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "tokens_of long, text string")
    assert {r.tokens_of: r.tokens for r in with_tokens(df, "text").collect()} == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    mix = plan_mix(docs, "doc_id", "text", F.col("source"), targets)
    assert [r.source for r in mix.short_sources().collect()] == ["a"]
    assert draw(mix).count() == 0 and reached_shares(mix).count() == 1


def test_many_targets_give_the_same(spark, mixed, monkeypatch):
    from chainweft.llm import mixing

    docs, mix = mixed
    want = {tuple(r) for r in reached_shares(mix).collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    targets = spark.createDataFrame([("big", 0.3, 1), ("small_one", 0.6, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    again = plan_mix(docs.drop("tokens"), "doc_id", "text", F.col("source"), targets, {"language": F.lower(F.substring(F.trim("lang"), 1, 2))})
    assert {tuple(r) for r in reached_shares(again).collect()} == want


def test_thousands_of_targets_are_exact(spark):
    many = 3000
    docs = spark.range(many * 2).selectExpr("id AS doc_id", "repeat('ether ', cast(1 + id % 7 AS int)) AS text", "IF(id % 5 = 0, 'de', 'en') AS lang", f"concat('S-', id % {many}) AS source")
    targets = spark.range(many + 5).selectExpr("concat('s_', id) AS source", f"1.0D / {many + 5} AS target_share", "cast(1 + id % 3 AS int) AS max_repeats")
    mix = plan_mix(docs, "doc_id", "text", F.col("source"), targets, {"language": F.col("lang")})
    sizes = {r.source.lower().replace("-", "_"): r.n for r in with_tokens(docs.drop("lang"), "text").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(sizes.values())
    want = {f"s_{k}" for k in range(many + 5) if total / (many + 5) > (1 + k % 3) * sizes.get(f"s_{k}", 0)}
    assert {r.source for r in mix.short_sources().collect()} == want and want > {f"s_{many + 4}"}
    out = reached_shares(mix).collect()
    assert len(out) == many + 5 and all(r.budget <= r.max_repeats * r.size + 1e-3 for r in out)
    assert sum(r.budget for r in out) == pytest.approx(min(total, sum((1 + k % 3) * sizes.get(f"s_{k}", 0) for k in range(many + 5))), abs=0.0005 * len(out))


def test_a_share_met_exactly_is_not_short(spark):
    docs = spark.createDataFrame([(k, "ether wallet", f"s{k % 3}") for k in range(9)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s0", 1 / 3, 1), ("s1", 1 / 3, 1), ("s2", 1 / 3, 1)], "source string, target_share double, max_repeats int")
    assert plan_mix(docs, "doc_id", "text", F.col("source"), targets).short_sources().count() == 0
