"""The five-transaction wallet graph and small cases of the other graph operators."""

from decimal import Decimal

import pytest

from chainweft.operators import crosschain, graph

T0 = 1_700_000_000
ROWS = [("A", "B", 1.0, 0), ("B", "C", 0.9, 10), ("C", "D", 0.8, 20), ("A", "E", 0.5, 30), ("E", "A", 0.4, 3600)]
SCHEMA = "seq long, sender string, recipient string, value_wei decimal(38,0), block_timestamp long"


def tx(spark, rows=ROWS):
    return spark.createDataFrame([(k, s, r, Decimal(int(v * 10**18)), T0 + t) for k, (s, r, v, t) in enumerate(rows)] + [(90, "A", None, Decimal(5), T0), (91, None, "B", Decimal(5), T0), (92, "", "B", None, T0)], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return graph.edges(tx(spark)).cache()


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "address string")


def test_edges_and_degrees(spark, edge):
    assert edge.count() == 5
    assert {r.address: (r.out_degree, r.in_degree) for r in graph.degrees(edge).collect()} == {"A": (2, 1), "B": (1, 1), "C": (1, 1), "D": (0, 1), "E": (1, 1)}
    assert {r.address: (r.tx_count, round(r.total_value_eth, 9)) for r in graph.wallet_totals(tx(spark)).collect()} == {"A": (2, 1.5), "B": (1, 0.9), "C": (1, 0.8), "D": (0, 0.0), "E": (1, 0.4)}


def test_repeated_pairs_collapse(spark):
    r = graph.edges(tx(spark, [("A", "B", 1.0, 50), ("A", "B", 2.0, 7)])).first()
    assert (r.first_seq, r.n, r.value_wei, r.last_time) == (0, 2, Decimal(3 * 10**18), T0 + 7)


def test_traversals(spark, edge):
    assert {(r.address, r.hops) for r in graph.ancestors(edge, start(spark, "D"), 3).collect()} == {("C", 1), ("B", 2), ("A", 3)}
    paths = sorted(">".join(r.path) for r in graph.simple_paths(edge, start(spark, "A"), 4).collect())
    assert paths == ["A>B", "A>B>C", "A>B>C>D", "A>E"]
    assert [">".join(r.path) for r in graph.simple_paths(edge, start(spark, "A"), 4, 3).orderBy("hops", "path").collect()] == ["A>B", "A>E", "A>B>C"]
    assert graph.simple_paths(edge, start(spark, "nobody"), 3).count() == 0
    assert {(r.src, r.dst, r.n) for r in graph.path_links(graph.simple_paths(edge, start(spark, "A"), 4)).collect()} == {("A", "B", 3), ("B", "C", 2), ("C", "D", 1), ("A", "E", 1)}


def test_round_trips(spark, edge):
    assert {(r.address, r.intermediate, r.round_trip_s) for r in graph.round_trips(edge).collect()} == {("A", "E", 3570)}
    assert graph.round_trips(edge, 3570).count() == 0


def test_risk(spark, edge):
    risk = spark.createDataFrame([("C", 0.1, False, 1), ("D", 0.9, True, 1), ("E", None, False, 2), ("B", 0.2, False, None)], "address string, risk double, f boolean, g long")
    from pyspark.sql import functions as F

    assert {r.address: r.risk for r in graph.spread_risk(risk, edge, F.col("f")).collect()}["C"] == pytest.approx(0.45)
    grouped = {r.address: r.risk for r in graph.group_risk(risk, "g").collect()}
    assert grouped["C"] == pytest.approx(0.63) and grouped["E"] is None and grouped["B"] == 0.2


def test_samples_and_index(spark, edge):
    wide = graph.edges(tx(spark, [(f"s{k}", "hub", 1.0, k) for k in range(40)]))
    one = {tuple(r) for r in graph.sampled_neighbours(wide, 5).collect()}
    assert len(one) == 5 and one == {tuple(r) for r in graph.sampled_neighbours(wide.repartition(3), 5).collect()}
    assert {tuple(r) for r in graph.edge_index(edge).collect()} == {(0, 1), (1, 2), (2, 3), (0, 4), (4, 0)}
    assert graph.first_counterparties(edge, 1).where("src = 'A'").first().dst == "B"


def test_communities(spark):
    clique = lambda n: [(f"{n}{i}", f"{n}{j}") for i in range(5) for j in range(5) if i < j]
    edge = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0"), ("a1", "a1")], "src string, dst string")
    labels = graph.label_communities(edge)
    assert len({r.community for r in labels.collect()}) == 2
    assert graph.modularity(edge, labels).first()[0] == pytest.approx(2 * (10 / 21 - 0.25), abs=1e-6)


def test_chains(spark):
    rows = spark.createDataFrame([(1, "x", "A", "B", "0xaa"), (2, "y", "A", None, "0xbb"), (3, None, "A", "B", None), (4, "y", "", "B", "0xAA")], "seq long, chain string, sender string, recipient string, selector string")
    assert {r.address: (r.chains, r.n_chains) for r in crosschain.chains_by_address(rows).collect()} == {"A": ("x,y", 2), "B": ("x,y", 2)}
    assert {(r.seq, r.chains_so_far) for r in crosschain.running_chains(rows).collect()} == {(1, 1), (2, 2), (3, 2)}
    registry = spark.createDataFrame([("0xAA", "bridge"), ("0xbb", "asset")], "selector string, kind string")
    hits = crosschain.registry_hits(rows, registry, "selector", {"bridge": "b", "asset": "a"})
    assert {tuple(r) for r in hits.collect()} == {("A", 1, 1)}
    boost = crosschain.activity_boost(crosschain.chains_by_address(rows), hits, "b", "a")
    assert {tuple(r) for r in boost.collect()} == {("A", 1.4), ("B", 1.15)}


def test_empty(spark):
    none = graph.edges(tx(spark, []).limit(0))
    assert graph.ancestors(none, start(spark, "A"), 2).count() == graph.degrees(none).count() == graph.edge_index(none).count() == graph.label_communities(none).count() == 0


def test_first_paths_equal_all_paths_cut(spark):
    import random

    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(40)}
    some = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src string, dst string")
    every = {}
    for r in graph.simple_paths(some, start(spark, "n0", "n1"), 4).collect():
        every.setdefault(r.start, []).append((r.hops, tuple(r.path)))
    for most in (1, 7, 40):
        got = {}
        for r in graph.simple_paths(some, start(spark, "n0", "n1"), 4, most).collect():
            got.setdefault(r.start, []).append((r.hops, tuple(r.path)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in every.items()}


def test_communities_are_settled(spark):
    import random

    rng = random.Random(8)
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(6) if i < j and rng.random() < 0.8] + [("a0", "b0"), ("b1", "c1"), ("x", "y"), ("y", "z"), ("z", "x2"), ("x2", "x")]
    label = {r.address: r.community for r in graph.label_communities(spark.createDataFrame(edges, "src string, dst string")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(label[b]), near.setdefault(b, []).append(label[a])
    assert all(max(map(own.count, own)) <= own.count(label[a]) for a, own in near.items())


def test_layers(spark):
    wide = spark.createDataFrame([(f"s{k}", "hub") for k in range(30)] + [(f"t{k}{j}", f"s{k}") for k in range(30) for j in range(4)], "src string, dst string")
    out = graph.sampled_layers(wide, start(spark, "hub"), [5, 2]).collect()
    first = {r.src for r in out if r.layer == 0}
    assert len(first) == 5 and {r.dst for r in out if r.layer == 1} == first and sum(r.layer for r in out) == 10


def test_flags_as_rows_arrive(spark):
    rows = spark.createDataFrame([(1, "x", "A", "B"), (2, "y", "A", "BR"), (3, "x", "BR", "C"), (4, "x", "D", "AS"), (5, "y", None, "AS"), (6, "x", "BR", "BR")], "seq long, chain string, sender string, recipient string")
    registry = spark.createDataFrame([("br", "gate", None), ("as", None, "coin")], "address string, bridge string, asset string")
    rows = rows.selectExpr("seq", "chain", "lower(sender) AS sender", "lower(recipient) AS recipient")
    got = {r.seq: (r.bridge, r.actor, r.asset, r.chains) for r in crosschain.observed(rows, registry).collect()}
    assert got == {1: (None, None, None, None), 2: ("gate", "a", None, "x,y"), 3: ("gate", "c", None, "x,y"), 4: (None, None, "coin", None), 5: (None, None, None, None), 6: ("gate", "br", None, "x,y")}
    assert {tuple(r) for r in crosschain.actor_summary(crosschain.observed(rows, registry)).collect()} == {("a", 1, "gate", 0), ("c", 1, "gate", 0), ("br", 1, "gate", 0), ("d", 0, "", 1)}
    assert crosschain.chain_summary(rows, registry).first().asDict() == {"wallets": 6, "multi_chain": 3, "bridge_wallets": 3, "bridge_hits": 3, "asset_hits": 1, "known_bridges": 1, "known_assets": 1}
