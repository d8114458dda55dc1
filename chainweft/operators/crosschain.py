"""Activity across chains and use of registered contracts, by wallet.

Running state is found from first occurrences: a wallet is on as many chains at one of its rows as have their first
row there no later. First occurrences are minima, combined before the shuffle, and small beside the rows.

Defined cases: rows without address or chain say nothing. Registry lookups disregard letter case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.operators.skew import lookup
from chainweft.session import WrittenTables


def sides(tx: DataFrame) -> DataFrame:
    """(address, chain, seq) for the sender and the recipient of each row."""
    flat = tx.select("seq", "chain", F.explode(F.array("sender", "recipient")).alias("address"))
    return flat.where((F.length("address") > 0) & F.col("chain").isNotNull())


def chains_by_address(tx: DataFrame) -> DataFrame:
    """(address, chains, n_chains): the chains each wallet was seen on, in order."""
    return sides(tx).groupBy("address").agg(F.sort_array(F.collect_set("chain")).alias("c")).select("address", F.concat_ws(",", "c").alias("chains"), F.size("c").cast("long").alias("n_chains"))


def registry_hits(tx: DataFrame, registry: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(address, one count for each kind): rows of a sender that meet an entry of a kind.

    ``registry`` is (key, kind), each key once; ``kinds`` maps kinds to the names of their counts.
    """
    known = registry.select(F.lower(key).alias(key), "kind")
    met = tx.where(F.length("sender") > 0).join(known, key).groupBy(F.col("sender").alias("address"))
    return met.agg(*(F.count_if(F.col("kind") == kind).alias(name) for kind, name in kinds.items()))


def activity_boost(chains: DataFrame, hits: DataFrame, bridge: str, asset: str) -> DataFrame:
    """(address, boost) by chains and registry hits: the strongest signal that holds."""
    joined = chains.join(hits, "address", "left")
    # The factors of the signals.
    over, many = F.coalesce(bridge, F.lit(0)) > 0, F.col("n_chains") > 1
    return joined.select("address", F.when(over & many, 1.4).when(over, 1.25).when(many, 1.15).when(F.coalesce(asset, F.lit(0)) > 0, 1.08).otherwise(1.0).alias("boost"))


def running_chains(tx: DataFrame) -> DataFrame:
    """(seq, sender, chains_so_far): on how many chains the sender was seen by each of its rows, on either side.

    Senders with very many rows are looked up apart.
    """
    tx, _ = WrittenTables(tx.sparkSession, "chains").write(tx.select("seq", "chain", "sender", "recipient"))
    first = sides(tx).groupBy("address", "chain").agg(F.min("seq").alias("since"))
    starts = first.groupBy(F.col("address").alias("sender")).agg(F.collect_list("since").alias("starts"))
    rows = tx.where(F.length("sender") > 0).select("seq", "sender")
    met = lookup(rows, starts, "sender", tx.count()).where(F.col("starts").isNotNull())
    return met.select("seq", "sender", F.size(F.filter("starts", lambda s: s <= F.col("seq"))).cast("long").alias("chains_so_far"))


def observed(tx: DataFrame, registry: DataFrame) -> DataFrame:
    """``tx`` (seq, chain, sender, recipient) with the flags that each row raises as it arrives.

    ``registry`` is (address, bridge, asset): the names under which an address is known as either, each address once.
    ``bridge`` is the recipient's or else the sender's, ``actor`` the other side of it, ``asset`` the recipient's where
    there is a sender, ``chains`` those that the sender was seen on by then, in order, if there are several.
    """
    tables = WrittenTables(tx.sparkSession, "observed")
    tx, _ = tables.write(tx.select("seq", "chain", "sender", "recipient"))
    known = registry.select(F.lower("address").alias("address"), "bridge", "asset")
    first = sides(tx).groupBy("address", "chain").agg(F.min("seq").alias("since"))
    starts = first.groupBy("address").agg(F.collect_list(F.struct("chain", "since")).alias("starts"))
    facts, _ = tables.write(starts.join(known, "address", "left").select(F.col("address").alias("sender"), "starts", F.col("bridge").alias("own_bridge")))
    met, _ = tables.write(lookup(tx, known.withColumnRenamed("address", "recipient").withColumnRenamed("bridge", "to_bridge"), "recipient", tx.count()))
    rows = lookup(met, facts, "sender", met.count())
    seen = F.sort_array(F.transform(F.filter("starts", lambda s: s["since"] <= F.col("seq")), lambda s: s["chain"]))
    return rows.select(
        "seq", "chain", "sender", "recipient", F.coalesce("to_bridge", "own_bridge").alias("bridge"),
        F.when(F.col("to_bridge").isNotNull(), F.col("sender")).when(F.col("own_bridge").isNotNull(), F.col("recipient")).alias("actor"),
        F.when(F.length("sender") > 0, F.col("asset")).alias("asset"), F.when(F.size(seen) > 1, F.concat_ws(",", seen)).alias("chains"),
    )


def actor_summary(flagged: DataFrame) -> DataFrame:
    """(address, bridge_hits, bridges, asset_hits) from ``observed``: what each wallet touched."""
    parts = F.array(F.struct(F.col("actor").alias("address"), F.col("bridge").alias("bridge"), F.lit(0).alias("asset")), F.struct(F.when(F.col("asset").isNotNull(), F.col("sender")).alias("address"), F.lit(None).cast("string").alias("bridge"), F.lit(1).alias("asset")))
    rows = flagged.select(F.explode(parts).alias("p")).select("p.*").where(F.length("address") > 0)
    return rows.groupBy("address").agg(F.count("bridge").alias("bridge_hits"), F.concat_ws(",", F.sort_array(F.collect_set("bridge"))).alias("bridges"), F.sum("asset").alias("asset_hits"))


def chain_summary(tx: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: wallets, those on several chains, those that touched bridges, hits of bridges and assets, registry sizes."""
    tx, _ = WrittenTables(tx.sparkSession, "summary").write(tx.select("seq", "chain", "sender", "recipient"))
    actors = actor_summary(observed(tx, registry))
    hits = actors.agg(F.count_if(F.col("bridge_hits") > 0).alias("bridge_wallets"), F.coalesce(F.sum("bridge_hits"), F.lit(0)).alias("bridge_hits"), F.coalesce(F.sum("asset_hits"), F.lit(0)).alias("asset_hits"))
    chains = chains_by_address(tx).agg(F.count(F.lit(1)).alias("wallets"), F.count_if(F.col("n_chains") > 1).alias("multi_chain"))
    sizes = registry.agg(F.count("bridge").alias("known_bridges"), F.count("asset").alias("known_assets"))
    return chains.crossJoin(hits).crossJoin(sizes)  # one row each
