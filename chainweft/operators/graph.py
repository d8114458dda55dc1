"""The directed wallet graph: edges and nodes from transactions, and bounded traversals.

Traversals start from a stated set of wallets and are bounded in depth; each level is one join of the frontier with
the edges, and what was reached is written to the shared folder, so lineage doesn't grow with depth.

Defined cases: rows without sender or recipient make no edge. Repeated transactions must be dropped before. Null
amounts count as 0. Paths visit no wallet twice; a wallet that isn't in the graph reaches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions.identity import ether
from chainweft.operators.distribution import running_totals
from chainweft.operators.skew import lookup
from chainweft.session import WrittenTables


def edges(tx: DataFrame) -> DataFrame:
    """One edge for each ordered pair: its first transaction, transactions, amount, and the time of the last arrival."""
    known = tx.where((F.length("sender") > 0) & (F.length("recipient") > 0))
    return known.groupBy(F.col("sender").alias("src"), F.col("recipient").alias("dst")).agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("value_wei"), F.lit(0)).alias("value_wei"),
        F.max(F.struct("seq", "block_timestamp"))["block_timestamp"].alias("last_time"),
    )


def degrees(edge: DataFrame) -> DataFrame:
    """(address, out_degree, in_degree, centrality) over distinct counterparties, centrality capped at 1."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("address"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("address"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    both = ends.groupBy("address").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return both.withColumn("centrality", F.least(F.lit(1.0), (F.col("out_degree") + F.col("in_degree")) / F.lit(100.0)))


def wallet_totals(tx: DataFrame) -> DataFrame:
    """(address, tx_count, total_value_eth) of every sender and recipient; recipients as such count nothing."""
    sent = F.coalesce((F.length("recipient") > 0) & (F.length("sender") > 0), F.lit(False))
    sides = F.array(F.struct(F.col("sender").alias("address"), sent.cast("int").alias("n"), F.when(sent, F.col("value_wei")).alias("v")), F.struct(F.col("recipient").alias("address"), F.lit(0).alias("n"), F.lit(None).cast("decimal(38,0)").alias("v")))
    flat = tx.select(F.explode(sides).alias("s")).select("s.*").where(F.length("address") > 0)
    return flat.groupBy("address").agg(F.sum("n").alias("tx_count"), ether(F.coalesce(F.sum("v"), F.lit(0))).alias("total_value_eth"))


def round_trips(edge: DataFrame, window_s: int = 86400) -> DataFrame:
    """Edges out of a wallet whose counterparty sent back later, but within the window; one row for each pair."""
    out = edge.select(F.col("src").alias("address"), F.col("dst").alias("intermediate"), F.col("last_time").alias("time_out"))
    back = edge.select(F.col("dst").alias("address"), F.col("src").alias("intermediate"), F.col("last_time").alias("time_in"), "value_wei")
    took = F.col("time_in") - F.col("time_out")
    return out.join(back, ["address", "intermediate"]).where((took > 0) & (took < window_s)).withColumn("round_trip_s", took)


def first_counterparties(edge: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, place): the first ``k`` recipients of each wallet in order of first transaction."""
    by = Window.partitionBy("src").orderBy("first_seq", "dst")
    return edge.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("src", "dst", "place")


def ancestors(edge: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(address, hops) of every wallet from which a start is reached in at most ``depth`` edges, the starts excluded."""
    tables = WrittenTables(edge.sparkSession, "ancestors")
    seen, _ = tables.write(starts.select("address").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        before = edge.join(seen.where(F.col("hops") == hop - 1).select(F.col("address").alias("dst")), "dst").select(F.col("src").alias("address")).distinct()
        seen, _ = tables.write(seen.unionByName(before.join(seen, "address", "left_anti").withColumn("hops", F.lit(hop))))
    return seen.where(F.col("hops") > 0)


def simple_paths(edge: DataFrame, starts: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(start, path, hops): paths without repetition of 1 to ``depth`` edges from each start.

    ``most`` is a report limit: the first paths of each start by length and wallets. A start that has as many is not
    followed further, as longer paths come after shorter ones; so a level never holds more than ``most`` paths of a
    start, times the edges of one wallet before ranks are cut in the map tasks.
    """
    tables = WrittenTables(edge.sparkSession, "paths")
    paths = starts.select(F.col("address").alias("start"), F.array("address").alias("path"), F.lit(0).cast("long").alias("had")).distinct()
    levels = []
    for _ in range(depth):
        steps = edge.select(F.col("src").alias("__at"), "dst")
        longer = paths.join(steps, F.element_at("path", -1) == F.col("__at")).where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path"), "had")
        if most is not None:
            longer = longer.withColumn("__k", F.row_number().over(Window.partitionBy("start").orderBy("path"))).where(F.col("__k") + F.col("had") <= most).drop("__k")
        level, _ = tables.write(longer)
        levels.append(level.select("start", "path"))
        paths = level
        if most is not None:
            now = level.groupBy("start").agg((F.first("had") + F.count(F.lit(1))).alias("now"))
            paths = level.join(now.where(F.col("now") < most), "start").select("start", "path", F.col("now").alias("had"))
    return reduce(DataFrame.unionByName, levels).withColumn("hops", F.size("path") - 1)


def path_links(paths: DataFrame) -> DataFrame:
    """(start, src, dst, n): consecutive pairs of the paths, with how many paths use them."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.select("start", F.inline(steps)).groupBy("start", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread_risk(risk: DataFrame, edge: DataFrame, flagged: Column, share: float = 0.5) -> DataFrame:
    """(address, risk): direct senders to a flagged wallet are raised to a share of its risk."""
    raised = edge.join(risk.where(flagged).select(F.col("address").alias("dst"), F.col("risk").alias("__r")), "dst").groupBy(F.col("src").alias("address")).agg((F.max("__r") * share).alias("__raised"))
    return risk.join(raised, "address", "left").select("address", F.greatest("risk", "__raised").alias("risk"))


def group_risk(risk: DataFrame, group: str, limit: float = 0.5, share: float = 0.7) -> DataFrame:
    """(address, group, group_risk, risk): members of a group whose highest risk exceeds the limit are raised to a share of it."""
    tops = risk.where(F.col(group).isNotNull()).groupBy(group).agg(F.max("risk").alias("group_risk"))
    joined = risk.join(tops, group, "left")
    return joined.select("address", group, "group_risk", F.when(F.col("group_risk") > limit, F.greatest(F.col("risk"), F.col("group_risk") * share)).otherwise(F.col("risk")).alias("risk"))


def sampled_neighbours(edge: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(dst, src): at most ``k`` senders of each wallet, in an order seeded by the pair.

    Candidates are cut to ``k`` in each map task before the shuffle by keeping the smallest of a seeded order, as any
    sender that isn't among the first ``k`` of its task can't be among the first ``k`` of all.
    """
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "src", "dst"), 256)
    by = Window.partitionBy("dst").orderBy("order", "src")
    return edge.select("src", "dst", order.alias("order")).withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= k).select("dst", "src")


def neighbour_means(edge: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """(address, means): the mean of each feature over the wallets that sent to the address.

    ``edge`` should be a written table; senders with very many edges are looked up apart.
    """
    met = lookup(edge.select("src", "dst"), features.withColumnRenamed("address", "src").withColumn("__met", F.lit(True)), "src", edge.count()).where("__met")
    return met.groupBy(F.col("dst").alias("address")).agg(*(F.avg(c).alias(c) for c in columns))


def sampled_layers(edge: DataFrame, seeds: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """(layer, dst, src): neighbours sampled outwards from the seeds, at most ``sizes[k]`` senders of a wallet in layer k.

    Each layer begins from the wallets that the one before first reached.
    """
    tables = WrittenTables(edge.sparkSession, "layers")
    seen, _ = tables.write(seeds.select("address").distinct())
    front, layers = seen, []
    for k, size in enumerate(sizes):
        near = edge.join(front.withColumnRenamed("address", "dst"), "dst", "left_semi")
        layer, _ = tables.write(sampled_neighbours(near, size, seed + k).withColumn("layer", F.lit(k)))
        layers.append(layer.select("layer", "dst", "src"))
        front, _ = tables.write(layer.select(F.col("src").alias("address")).distinct().join(seen, "address", "left_anti"))
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, layers)


def label_communities(edge: DataFrame) -> DataFrame:
    """(address, community) by label propagation on the undirected graph, to the end.

    A wallet wants the label that most of its neighbours have, if more have it than have its own, the smallest of
    several. In each round those wallets change that come first, in an order seeded by the round, among their neighbours
    who want to. No two neighbours change at once, so each round raises the number of edges within communities: rounds
    end, and when they do no wallet wants another label.
    """
    tables = WrittenTables(edge.sparkSession, "communities")
    both = edge.where(F.col("src") != F.col("dst")).select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.*").distinct()
    both, _ = tables.write(both)
    labels, at = tables.write(both.select(F.col("a").alias("address")).distinct().withColumn("community", F.col("address")))
    turn = 0
    while True:
        votes = both.join(labels.withColumnRenamed("address", "b"), "b").groupBy(F.col("a").alias("address"), "community").agg(F.count(F.lit(1)).alias("n"))
        most = votes.groupBy("address").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best"))
        own = labels.join(votes, ["address", "community"], "left").select("address", "community", F.coalesce("n", F.lit(0)).alias("n"))
        order = F.struct(F.xxhash64("address", F.lit(turn)), "address")
        wish, wish_at = tables.write(own.join(most, "address").where(-F.col("best.n") > F.col("n")).select("address", F.col("best.community").alias("new"), order.alias("turn")))
        if not wish.limit(1).count():
            return labels
        rival = both.join(wish.select(F.col("address").alias("b"), F.col("turn").alias("other")), "b").groupBy(F.col("a").alias("address")).agg(F.min("other").alias("other"))
        moved = wish.join(rival, "address", "left").where(F.col("other").isNull() | (F.col("turn") < F.col("other"))).select("address", "new")
        new, new_at = tables.write(labels.join(moved, "address", "left").select("address", F.coalesce("new", "community").alias("community")))
        tables.drop(at), tables.drop(wish_at)
        labels, at = new, new_at
        turn += 1


def modularity(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): how much denser the communities are than chance, on the undirected unweighted graph."""
    both = edge.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    named = both.join(labels.select(F.col("address").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("address").alias("b"), F.col("community").alias("cb")), "b")
    ends = named.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("i")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("i")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.count(F.lit(1)).alias("d"), F.sum("i").alias("i"))
    return per.agg(F.sum("i").alias("i"), F.sum("d").alias("d"), F.sum(F.col("d").cast("double") * F.col("d")).alias("dd")).select(F.round(2 * F.col("i") / F.col("d") - F.col("dd") / (F.col("d").cast("double") * F.col("d")), 6).alias("modularity"))


def edge_index(edge: DataFrame) -> DataFrame:
    """(src_id, dst_id): edges between dense numbers of the wallets in their order."""
    ends = edge.select(F.explode(F.array("src", "dst")).alias("address")).distinct().withColumn("one", F.lit(1).cast("long"))
    number, _ = WrittenTables(edge.sparkSession, "index").write(running_totals(ends, [], ["address"], ["one"]).select("address", (F.col("upto_one") - 1).alias("id")))
    slim, _ = WrittenTables(edge.sparkSession, "index").write(edge.select("src", "dst"))
    many = slim.count()
    named, _ = WrittenTables(edge.sparkSession, "index").write(lookup(slim, number.select(F.col("address").alias("src"), F.col("id").alias("src_id")), "src", many))
    return lookup(named, number.select(F.col("address").alias("dst"), F.col("id").alias("dst_id")), "dst", many).select("src_id", "dst_id")
