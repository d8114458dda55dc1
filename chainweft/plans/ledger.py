"""Queries on normalised transactions: fields, velocity, distributions, the wallet graph and activity across chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweft.functions.identity import address, ether
from chainweft.operators import crosschain, distribution, graph, transactions, velocity
from chainweft.session import WrittenTables
from chainweft.sources.tables import table

THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]
GAS_BUCKETS = [21000, 50000, 100000, 200000, 500000, 1000000]


#: Paths of distinct tables that ``share_distinct`` wrote, by session and folder.
_SHARED: dict[tuple[str, str], str] = {}


def share_distinct(spark: SparkSession, folder: str) -> None:
    """Writes the distinct transactions of a folder once, for all queries of this session that begin with them."""
    rows = transactions.distinct_transactions(table(spark, folder, "chain_tx"), transactions.NORMALISED)
    _SHARED[spark.sparkContext.applicationId, folder] = WrittenTables(spark, "distinct").write(rows)[1]


def _tx(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The distinct transactions, from the shared table if there is one, else made anew."""
    if path := _SHARED.get((spark.sparkContext.applicationId, folder)):
        return spark.read.parquet(path).select(*columns)
    return transactions.distinct_transactions(table(spark, folder, "chain_tx"), list(columns))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(_tx(spark, folder, "seq", "sender", "recipient", "value_wei", "block_timestamp"))


def _link_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "wallet_links").where("is_match")
    pairs = links.select(address(F.col("from_addr")).alias("src"), address(F.col("to_addr")).alias("dst"))
    return pairs.where(F.col("src") != F.col("dst")).distinct()


def _risk(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "wallets").select(F.lower("address").alias("address"), F.col("risk_score").alias("risk"), F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"), "cluster_id")


def tx_normalized(spark, folder):
    """Every delivery with canonical spellings and derived fields."""
    rows = transactions.normalise(table(spark, folder, "chain_tx"))
    return rows.withColumns({c: F.round(c, 9) for c in ("value_eth", "log_value_eth", "gas_price_gwei")}).drop("value_wei")


def tx_distinct(spark, folder):
    """One row for each hash."""
    return _tx(spark, folder, "seq", "tx_hash", "sender", "recipient", "selector", "chain")


def tx_log_summary(spark, folder):
    """A short form of each transaction for logs."""
    tx = _tx(spark, folder, "seq", "tx_hash", "sender", "recipient", "value_eth")
    return tx.select("seq", F.concat(F.substring("tx_hash", 1, 12), F.lit("...")).alias("tx"), F.substring("sender", 1, 10).alias("sender"), F.coalesce(F.substring("recipient", 1, 10), F.lit("CONTRACT_CREATION")).alias("recipient"), F.round("value_eth", 9).alias("value_eth"))


def velocity_1h(spark, folder):
    """Count, sum and gap of each transaction's sender over the hour before it; flagged above twenty, a burst from twenty on."""
    rows = velocity.recent_activity(_tx(spark, folder, "seq", "sender", "block_timestamp", "value_wei"), "sender", "block_timestamp", "seq", "value_wei")
    return rows.select("seq", "sender", "tx_count", F.round(ether(F.col("value_sum")), 9).alias("value_sum"), F.col("since_last").alias("since_last"), (F.col("tx_count") > 20).alias("velocity_flag"), "is_burst")


def velocity_24h(spark, folder):
    """The same over the day before each transaction, with bursts from five on."""
    rows = velocity.recent_activity(_tx(spark, folder, "seq", "sender", "block_timestamp", "value_wei"), "sender", "block_timestamp", "seq", "value_wei", 86400, 5)
    return rows.select("seq", "tx_count", F.col("since_last").alias("since_last"), "is_burst")


def velocity_on_arrival(spark, folder):
    """What each delivery's sender had done in the hour before it, as known when it arrived."""
    tx = transactions.normalise(table(spark, folder, "chain_tx")).select("seq", "sender", "block_timestamp", "value_eth")
    return velocity.arrival_activity(tx, "sender", "block_timestamp", "seq", "value_eth")


def last_row_per_sender(spark, folder):
    """Each sender's latest transaction."""
    tx = _tx(spark, folder, "seq", "sender", "block_timestamp", "gas", "input_length").where(F.length("sender") > 0)
    last = tx.groupBy("sender").agg(F.max(F.struct("block_timestamp", "seq", "gas", "input_length")).alias("r"))
    return last.select("sender", "r.*")


def gas_percentile(spark, folder):
    """The share of a chain's transactions that use no more gas, by amount of gas."""
    shares = distribution.cumulative_share(_tx(spark, folder, "chain", "gas"), ["chain"], "gas")
    return shares.withColumn("share", F.round("share", 9))


def value_stats_by_chain(spark, folder):
    """Mean, deviation, median, 95th percentile, sum and maximum of gas by chain."""
    stats = distribution.value_statistics(_tx(spark, folder, "chain", "gas"), ["chain"], "gas", {"median": 0.5, "p95": 0.95})
    return stats.select("chain", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), F.round("median", 3).alias("median"), F.round("p95", 3).alias("p95"), F.col("sum").alias("total"), F.col("max").alias("most"))


def wallet_totals(spark, folder):
    rows = graph.wallet_totals(_tx(spark, folder, "sender", "recipient", "value_wei"))
    return rows.withColumn("total_value_eth", F.round("total_value_eth", 9))


def edge_totals(spark, folder):
    """The collapsed edges of the wallet graph."""
    return _edges(spark, folder).select("src", "dst", "first_seq", "n", F.round(ether(F.col("value_wei")), 9).alias("value_eth"), "last_time")


def wallet_degrees(spark, folder):
    return graph.degrees(_edges(spark, folder)).withColumn("centrality", F.round("centrality", 6))


def graph_size(spark, folder):
    """Nodes, edges and self-loops of the wallet graph."""
    edge = _edges(spark, folder)
    ends = edge.select("src", "dst", F.explode(F.array("src", "dst")).alias("a"))
    return ends.agg(F.countDistinct("a").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"), (F.count_if(F.col("src") == F.col("dst")) / 2).cast("long").alias("loops"))


def round_trips_day(spark, folder):
    return graph.round_trips(_edges(spark, folder)).select("address", "intermediate", "time_out", "time_in", "round_trip_s", F.round(ether(F.col("value_wei")), 9).alias("value_eth"))


def round_trips_week(spark, folder):
    return graph.round_trips(_edges(spark, folder), 7 * 86400).select("address", "intermediate", "round_trip_s")


def first_counterparties(spark, folder):
    return graph.first_counterparties(_edges(spark, folder))


def ancestors_of_flagged(spark, folder):
    """Wallets from which a flagged wallet is reached by transactions in at most five steps."""
    edge, _ = WrittenTables(spark, "edges").write(_edges(spark, folder).select("src", "dst"))
    return graph.ancestors(edge, _risk(spark, folder).where("is_flagged"), 5)


def _first_paths(spark, folder):
    edge, _ = WrittenTables(spark, "edges").write(_edges(spark, folder).select("src", "dst"))
    return graph.simple_paths(edge, _risk(spark, folder).where("is_flagged"), 5, 100)


def paths_from_flagged(spark, folder):
    """The first hundred simple paths of at most five steps from each flagged wallet."""
    return _first_paths(spark, folder).select("start", F.concat_ws(">", "path").alias("path"), F.col("hops").cast("long").alias("hops"))


def path_flow_links(spark, folder):
    """How many of those paths use each link."""
    return graph.path_links(_first_paths(spark, folder))


def risk_spread(spark, folder):
    """Risk after half of a flagged wallet's risk is passed to those who sent to it."""
    rows = graph.spread_risk(_risk(spark, folder), _edges(spark, folder), F.col("is_flagged"))
    return rows.withColumn("risk", F.round("risk", 6))


def group_risk(spark, folder):
    """Risk after a risky stored group raises its members."""
    rows = graph.group_risk(_risk(spark, folder), "cluster_id")
    return rows.withColumns({"risk": F.round("risk", 6), "group_risk": F.round("group_risk", 6)})


def neighbour_sample(spark, folder):
    """At most five senders of each wallet."""
    return graph.sampled_neighbours(_edges(spark, folder), 5)


def neighbour_means(spark, folder):
    """Mean risk of the wallets that sent to each wallet."""
    edge, _ = WrittenTables(spark, "edges").write(_edges(spark, folder).select("src", "dst"))
    rows = graph.neighbour_means(edge, _risk(spark, folder).select("address", "risk"), ["risk"])
    return rows.withColumn("risk", F.round("risk", 12))


def edge_index(spark, folder):
    return graph.edge_index(_edges(spark, folder))


def communities(spark, folder):
    """Communities of matched links."""
    return graph.label_communities(_link_edges(spark, folder))


def community_quality(spark, folder):
    """Modularity of those communities."""
    edge = _link_edges(spark, folder)
    return graph.modularity(edge, graph.label_communities(edge))


def chains_by_address(spark, folder):
    return crosschain.chains_by_address(_tx(spark, folder, "seq", "chain", "sender", "recipient"))


def multi_chain_wallets(spark, folder):
    rows = crosschain.chains_by_address(_tx(spark, folder, "seq", "chain", "sender", "recipient"))
    return rows.where(F.col("n_chains") > 1).select("address", "n_chains")


def _hits(spark, folder):
    registry = table(spark, folder, "methods").select("selector", F.col("category").alias("kind"))
    return crosschain.registry_hits(_tx(spark, folder, "sender", "selector"), registry, "selector", {"bridge": "bridge_hits", "staking": "staking_hits"})


def registry_hits(spark, folder):
    """Calls of bridge and staking methods by sender."""
    return _hits(spark, folder)


def activity_boost(spark, folder):
    rows = crosschain.activity_boost(crosschain.chains_by_address(_tx(spark, folder, "seq", "chain", "sender", "recipient")), _hits(spark, folder), "bridge_hits", "staking_hits")
    return rows


def running_chains(spark, folder):
    return crosschain.running_chains(_tx(spark, folder, "seq", "chain", "sender", "recipient"))


def _registry(spark, folder):
    """Known contracts: wallets with a label, mixers in the place of bridges and contracts in that of assets."""
    label = F.lower(F.trim("entity_label"))
    known = table(spark, folder, "wallets").where(label.isin("mixer", "contract"))
    return known.select(F.lower("address").alias("address"), F.when(label == "mixer", F.concat(F.lit("mixer "), F.substring(F.lower("address"), 3, 6))).alias("bridge"), F.when(label == "contract", F.concat(F.lit("asset "), F.substring(F.lower("address"), 3, 6))).alias("asset"))


def chain_flags(spark, folder):
    """What each transaction shows as it arrives: contact with registered contracts and activity on several chains."""
    return crosschain.observed(_tx(spark, folder, "seq", "chain", "sender", "recipient"), _registry(spark, folder)).select("seq", "bridge", "actor", "asset", "chains")


def chain_actors(spark, folder):
    """Registered contracts that each wallet touched."""
    return crosschain.actor_summary(crosschain.observed(_tx(spark, folder, "seq", "chain", "sender", "recipient"), _registry(spark, folder)))


def chain_stats(spark, folder):
    """Seven numbers on activity across chains."""
    return crosschain.chain_summary(_tx(spark, folder, "seq", "chain", "sender", "recipient"), _registry(spark, folder))


def sustained_hours(spark, folder):
    """Runs of at least three hours in a row in which a chain has more than half as many transactions as in its busiest one."""
    tx = _tx(spark, folder, "chain", "block_timestamp")
    hours = tx.groupBy("chain", F.floor(F.col("block_timestamp") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("chain")  # one row for each hour
    high = hours.withColumn("top", F.max("n").over(by)).where(F.col("n") > 0.5 * F.col("top"))
    runs = high.withColumn("run", F.col("hour") - F.row_number().over(by.orderBy("hour")))
    return runs.groupBy("chain", "run").agg(F.min("hour").alias("start"), F.count(F.lit(1)).alias("hours")).where(F.col("hours") >= 3).select("chain", "start", "hours")


def cross_chain_summary(spark, folder):
    """Wallets, those on several chains, and calls of bridge methods, in one row."""
    chains = crosschain.chains_by_address(_tx(spark, folder, "seq", "chain", "sender", "recipient"))
    hits = _hits(spark, folder)
    one = chains.agg(F.count(F.lit(1)).alias("wallets"), F.count_if(F.col("n_chains") > 1).alias("multi_chain"))
    two = hits.agg(F.count_if(F.col("bridge_hits") > 0).alias("bridge_users"), F.coalesce(F.sum("bridge_hits"), F.lit(0)).alias("bridge_calls"))
    return one.select("*", two.select("bridge_users").scalar().alias("bridge_users"), two.select("bridge_calls").scalar().alias("bridge_calls"))


def calls_by_category(spark, folder):
    """Transactions by method category, categories without any included."""
    methods = table(spark, folder, "methods").select(F.lower("selector").alias("selector"), F.coalesce("category", F.lit("none")).alias("category"))
    counts = _tx(spark, folder, "selector").groupBy("selector").agg(F.count(F.lit(1)).alias("n"))
    return methods.join(counts, "selector", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def watchlist_rows(spark, folder):
    """Transactions sent by flagged wallets."""
    flagged = _risk(spark, folder).where("is_flagged").select(F.col("address").alias("sender"))
    return _tx(spark, folder, "seq", "sender").join(flagged, "sender", "left_semi")


def unlisted_senders(spark, folder):
    """Senders that aren't among the stored wallets, with at least three transactions."""
    known = _risk(spark, folder).select(F.col("address").alias("sender"))
    senders = _tx(spark, folder, "sender").where(F.length("sender") > 0).groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    return senders.where(F.col("n") >= 3).join(known, "sender", "left_anti")


def top_senders(spark, folder):
    """The twenty senders with the most transactions."""
    counts = _tx(spark, folder, "sender").where(F.length("sender") > 0).groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "sender").limit(20)


def rate_5m(spark, folder):
    """Transactions by chain and five minutes."""
    tx = _tx(spark, folder, "chain", "block_timestamp")
    return tx.groupBy("chain", (F.floor(F.col("block_timestamp") / 300) * 300).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / 300.0, 6).alias("rate"))


def mean_shift_24h(spark, folder):
    """Hourly mean gas against the same hour of the day before."""
    hours = _tx(spark, folder, "chain", "block_timestamp", "gas").groupBy("chain", F.floor(F.col("block_timestamp") / 3600).alias("hour")).agg(F.avg("gas").alias("mean"))
    before = hours.select("chain", (F.col("hour") + 24).alias("hour"), F.col("mean").alias("was"))
    return hours.join(before, ["chain", "hour"]).select("chain", "hour", F.round(F.col("mean") - F.col("was"), 3).alias("shift"))


def le_buckets(spark, folder):
    """Cumulative gas buckets by chain."""
    tx = _tx(spark, folder, "chain", "gas")
    counts = tx.groupBy("chain").agg(*(F.count_if(F.col("gas") <= b).alias(f"b{b}") for b in GAS_BUCKETS), F.count("gas").alias("every"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in GAS_BUCKETS), F.struct(F.lit("+Inf").alias("le"), F.col("every").alias("n")))
    return counts.select("chain", F.inline(rows))


def bucket_quantile(spark, folder):
    """The 90th percentile of gas by chain, interpolated in the buckets."""
    tx = _tx(spark, folder, "chain", "gas")
    edges = [0, *GAS_BUCKETS]
    counts = tx.groupBy("chain").agg(F.count("gas").alias("every"), *(F.count_if(F.col("gas") <= b).alias(f"b{b}") for b in edges))
    rank, value = F.lit(0.9) * F.col("every"), F.lit(float(edges[-1]))
    for low, high in reversed(list(zip(edges, edges[1:]))):
        below, upto = F.col(f"b{low}") if low else F.lit(0), F.col(f"b{high}")
        value = F.when(upto >= rank, low + (high - low) * (rank - below) / (upto - below)).otherwise(value)
    return counts.select("chain", F.round(value, 3).alias("p90"))


def score_histogram(spark, folder):
    """Twenty bins of wallet risk, flagged or not."""
    return distribution.histogram(_risk(spark, folder), ["is_flagged"], "risk", 0.0, 1.0, 20).withColumn("n", F.col("n").cast("long"))


def score_drift(spark, folder):
    """How far gas percentiles on one chain have moved from those on the other."""
    rows = table(spark, folder, "tx_features").select(F.lower("chain_name").alias("chain"), "gas_price_percentile")
    return distribution.stability_index(rows, F.col("chain") == "polygon-mainnet", "gas_price_percentile")


def _scored(spark, folder):
    return _risk(spark, folder).select("risk", "is_flagged")


def threshold_sweep(spark, folder):
    """Confusion counts and rates of wallet risk against flags at nineteen thresholds."""
    return distribution.threshold_metrics(_scored(spark, folder), "risk", F.col("is_flagged"), THRESHOLDS)


def best_threshold(spark, folder):
    return distribution.best_threshold(threshold_sweep(spark, folder))


def ranked_quality(spark, folder):
    return distribution.ranked_quality(_scored(spark, folder), "risk", F.col("is_flagged"))


def precision_threshold(spark, folder):
    return distribution.precision_threshold(_scored(spark, folder), "risk", F.col("is_flagged"), 0.3)


_NAMES = [tx_normalized, tx_distinct, tx_log_summary, velocity_1h, velocity_24h, velocity_on_arrival, last_row_per_sender, gas_percentile, value_stats_by_chain, wallet_totals, edge_totals, wallet_degrees, graph_size, round_trips_day, round_trips_week, first_counterparties, ancestors_of_flagged, paths_from_flagged, path_flow_links, risk_spread, group_risk, neighbour_sample, neighbour_means, edge_index, communities, community_quality, chains_by_address, multi_chain_wallets, registry_hits, activity_boost, running_chains, chain_flags, chain_actors, chain_stats, sustained_hours, cross_chain_summary, calls_by_category, watchlist_rows, unlisted_senders, top_senders, rate_5m, mean_shift_24h, le_buckets, bucket_quantile, score_histogram, score_drift, threshold_sweep, best_threshold, ranked_quality, precision_threshold]
QUERIES = {f.__name__: f for f in _NAMES}

_HEX = "regexp_replace(lower(trim({0})), '^0x', '')"
_ADDR = "CASE WHEN length(regexp_replace(lower(trim({0})), '^0x', '')) > 0 THEN '0x' || regexp_replace(lower(trim({0})), '^0x', '') END"
NORM = f"""norm AS (SELECT seq, '0x' || {_HEX.format('tx_hash')} AS tx_hash, block_number, block_timestamp, {_ADDR.format('from_addr')} AS sender, {_ADDR.format('to_addr')} AS recipient,
 value_wei, value_wei::DOUBLE / 1e18 AS value_eth, ln(1 + value_wei::DOUBLE / 1e18) AS log_value_eth, CASE WHEN value_wei::DOUBLE / 1e18 > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_high_value,
 gas, gas_price::DOUBLE / 1e9 AS gas_price_gwei, CASE WHEN length(input_data) >= 10 THEN lower(left(input_data, 10)) ELSE '0x' END AS selector,
 greatest(0, (coalesce(length(input_data), 2) - 2) // 2)::BIGINT AS input_length, coalesce(to_addr, '') = '' AS is_creation,
 coalesce(to_addr, '') <> '' AND coalesce(length(input_data), 0) > 2 AS is_call, lower(trim(chain_name)) AS chain FROM chain_tx)"""
TX = NORM + ", tx AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY seq) = 1)"
EDGE = TX + """, edge AS (SELECT sender AS src, recipient AS dst, min(seq) AS first_seq, count(*) AS n, sum(value_wei)::DECIMAL(38,0) AS value_wei, arg_max(block_timestamp, seq) AS last_time
 FROM tx WHERE sender IS NOT NULL AND recipient IS NOT NULL GROUP BY 1, 2)"""
LINK = "link AS (SELECT DISTINCT lower(trim(from_addr)) AS src, lower(trim(to_addr)) AS dst FROM wallet_links WHERE is_match AND lower(trim(from_addr)) <> lower(trim(to_addr)))"
RISK = "risk AS (SELECT lower(address) AS address, risk_score AS risk, coalesce(is_flagged, false) AS is_flagged, cluster_id FROM wallets)"
CHAINS = TX + ", side AS (SELECT seq, chain, sender AS address FROM tx UNION ALL SELECT seq, chain, recipient FROM tx), chains AS (SELECT address, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, count(DISTINCT chain) AS n_chains FROM side WHERE address IS NOT NULL AND chain IS NOT NULL GROUP BY 1)"
HITS = ", hits AS (SELECT sender AS address, count(*) FILTER (category = 'bridge') AS bridge_hits, count(*) FILTER (category = 'staking') AS staking_hits FROM tx JOIN methods m ON lower(m.selector) = tx.selector WHERE sender IS NOT NULL GROUP BY 1)"
_WIN = "OVER (PARTITION BY sender ORDER BY block_timestamp RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"
_GAP = "block_timestamp - lag(block_timestamp) OVER (PARTITION BY sender ORDER BY block_timestamp, seq)"
_OBSERVED = CHAINS + """, reg AS (SELECT lower(address) AS address, CASE WHEN lower(trim(entity_label)) = 'mixer' THEN 'mixer ' || substr(lower(address), 3, 6) END AS bridge, CASE WHEN lower(trim(entity_label)) = 'contract' THEN 'asset ' || substr(lower(address), 3, 6) END AS asset FROM wallets WHERE lower(trim(entity_label)) IN ('mixer', 'contract')),
since AS (SELECT address, chain, min(seq) AS s FROM side WHERE address IS NOT NULL AND chain IS NOT NULL GROUP BY 1, 2),
seen AS (SELECT tx.seq, string_agg(since.chain, ',' ORDER BY since.chain) AS chains FROM tx JOIN since ON since.address = tx.sender AND since.s <= tx.seq GROUP BY 1 HAVING count(*) > 1),
obs AS (SELECT tx.seq, tx.sender, coalesce(t.bridge, f.bridge) AS bridge, CASE WHEN t.bridge IS NOT NULL THEN tx.sender WHEN f.bridge IS NOT NULL THEN tx.recipient END AS actor, CASE WHEN tx.sender IS NOT NULL THEN t.asset END AS asset, seen.chains
 FROM tx LEFT JOIN reg t ON t.address = tx.recipient LEFT JOIN reg f ON f.address = tx.sender LEFT JOIN seen USING (seq)),
act AS (SELECT address, count(bridge) AS bridge_hits, coalesce(string_agg(DISTINCT bridge, ',' ORDER BY bridge), '') AS bridges, count(asset) AS asset_hits FROM (SELECT actor AS address, bridge, NULL AS asset FROM obs UNION ALL SELECT CASE WHEN asset IS NOT NULL THEN sender END, NULL, asset FROM obs) WHERE address IS NOT NULL GROUP BY 1)"""
_BIN20 = " + ".join(f"(risk >= {round(0.05 * k, 12)})::INT" for k in range(1, 20))
_BIN10 = " + ".join(f"(gas_price_percentile >= {round(0.1 * k, 12)})::INT" for k in range(1, 10))
_STEPS = ", ".join(f"({t})" for t in THRESHOLDS)
_SWEEP = f"""{RISK}, cell AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (risk >= t AND is_flagged) AS tp, count(*) FILTER (risk >= t AND NOT is_flagged) AS fp, count(*) FILTER (risk < t AND is_flagged) AS fn, count(*) FILTER (risk < t AND NOT is_flagged) AS tn
 FROM risk, (VALUES {_STEPS}) s(t) WHERE risk IS NOT NULL GROUP BY t),
sweep AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 4) AS accuracy FROM cell)"""
_CURVE = f"""{RISK}, cnt AS (SELECT risk, count(*) FILTER (is_flagged) AS p, count(*) FILTER (NOT is_flagged) AS n FROM risk WHERE risk IS NOT NULL GROUP BY 1),
curve AS (SELECT risk, p, n, sum(p) OVER (ORDER BY risk DESC) AS up, sum(n) OVER (ORDER BY risk DESC) AS un FROM cnt)"""
_PATHS = f"""WITH RECURSIVE {EDGE}, {RISK}, walk(start, path, node, hops) AS (SELECT address, [address], address, 0 FROM (SELECT DISTINCT address FROM risk WHERE is_flagged)
 UNION ALL SELECT w.start, list_append(w.path, l.dst), l.dst, w.hops + 1 FROM walk w JOIN edge l ON l.src = w.node WHERE w.hops < 5 AND NOT list_contains(w.path, l.dst)
 QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY list_append(w.path, l.dst)) <= 100),
first AS (SELECT * FROM walk WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops, path) <= 100)"""

ORACLES = {
    "tx_normalized": f"WITH {NORM} SELECT seq, tx_hash, block_number, block_timestamp, sender, recipient, round(value_eth, 9) AS value_eth, round(log_value_eth, 9) AS log_value_eth, is_high_value, gas, round(gas_price_gwei, 9) AS gas_price_gwei, selector, input_length, is_creation, is_call, chain FROM norm",
    "tx_distinct": f"WITH {TX} SELECT seq, tx_hash, sender, recipient, selector, chain FROM tx",
    "tx_log_summary": f"WITH {TX} SELECT seq, left(tx_hash, 12) || '...' AS tx, left(sender, 10) AS sender, coalesce(left(recipient, 10), 'CONTRACT_CREATION') AS recipient, round(value_eth, 9) AS value_eth FROM tx",
    "velocity_1h": f"WITH {TX}, v AS (SELECT seq, sender, count(*) {_WIN.format(3600)} AS tx_count, sum(value_wei) {_WIN.format(3600)} AS s, {_GAP} AS gap FROM tx WHERE sender IS NOT NULL) SELECT seq, sender, tx_count, round(s::DECIMAL(38,0)::DOUBLE / 1e18, 9) AS value_sum, CASE WHEN gap <= 3600 THEN gap ELSE -1 END AS since_last, tx_count > 20 AS velocity_flag, tx_count >= 20 AS is_burst FROM v",
    "velocity_24h": f"WITH {TX}, v AS (SELECT seq, count(*) {_WIN.format(86400)} AS tx_count, {_GAP} AS gap FROM tx WHERE sender IS NOT NULL) SELECT seq, tx_count, CASE WHEN gap <= 86400 THEN gap ELSE -1 END AS since_last, tx_count >= 5 AS is_burst FROM v",
    "last_row_per_sender": f"WITH {TX} SELECT sender, block_timestamp, seq, gas, input_length FROM tx WHERE sender IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sender ORDER BY block_timestamp DESC, seq DESC) = 1",
    "gas_percentile": f"WITH {TX} SELECT DISTINCT chain, gas, round(cume_dist() OVER (PARTITION BY chain ORDER BY gas), 9) AS share FROM tx WHERE gas IS NOT NULL",
    "value_stats_by_chain": f"WITH {TX} SELECT chain, count(gas) AS n, round(avg(gas), 3) AS mean, round(stddev_pop(gas), 3) AS std, round(quantile_cont(gas, 0.5), 3) AS median, round(quantile_cont(gas, 0.95), 3) AS p95, sum(gas)::DOUBLE AS total, max(gas)::DOUBLE AS most FROM tx GROUP BY 1",
    "wallet_totals": f"WITH {TX}, flat AS (SELECT sender AS address, CASE WHEN recipient IS NOT NULL AND sender IS NOT NULL THEN 1 ELSE 0 END AS n, CASE WHEN recipient IS NOT NULL THEN value_wei END AS v FROM tx UNION ALL SELECT recipient, 0, NULL FROM tx) SELECT address, sum(n)::BIGINT AS tx_count, round(coalesce(sum(v), 0)::DECIMAL(38,0)::DOUBLE / 1e18, 9) AS total_value_eth FROM flat WHERE address IS NOT NULL GROUP BY 1",
    "edge_totals": f"WITH {EDGE} SELECT src, dst, first_seq, n, round(value_wei::DOUBLE / 1e18, 9) AS value_eth, last_time FROM edge",
    "wallet_degrees": f"WITH {EDGE}, e AS (SELECT src AS address, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) SELECT address, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(least(1.0, (sum(o) + sum(i)) / 100.0)::DOUBLE, 6) AS centrality FROM e GROUP BY 1",
    "graph_size": f"WITH {EDGE} SELECT (SELECT count(*) FROM (SELECT src FROM edge UNION SELECT dst FROM edge)) AS nodes, count(*) AS edges, count(*) FILTER (src = dst) AS loops FROM edge",
    "round_trips_day": f"WITH {EDGE} SELECT o.src AS address, o.dst AS intermediate, o.last_time AS time_out, b.last_time AS time_in, b.last_time - o.last_time AS round_trip_s, round(b.value_wei::DOUBLE / 1e18, 9) AS value_eth FROM edge o JOIN edge b ON b.src = o.dst AND b.dst = o.src WHERE b.last_time - o.last_time > 0 AND b.last_time - o.last_time < 86400",
    "round_trips_week": f"WITH {EDGE} SELECT o.src AS address, o.dst AS intermediate, b.last_time - o.last_time AS round_trip_s FROM edge o JOIN edge b ON b.src = o.dst AND b.dst = o.src WHERE b.last_time - o.last_time > 0 AND b.last_time - o.last_time < 604800",
    "first_counterparties": f"WITH {EDGE} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY first_seq, dst)::INT AS place FROM edge QUALIFY place <= 10",
    "ancestors_of_flagged": f"WITH RECURSIVE {EDGE}, {RISK}, up(address, hops) AS (SELECT address, 0 FROM risk WHERE is_flagged UNION SELECT l.src, u.hops + 1 FROM up u JOIN edge l ON l.dst = u.address WHERE u.hops < 5) SELECT address, min(hops)::INT AS hops FROM up GROUP BY 1 HAVING min(hops) > 0",
    "paths_from_flagged": _PATHS + " SELECT start, array_to_string(path, '>') AS path, hops::BIGINT AS hops FROM first",
    "path_flow_links": _PATHS + " SELECT start, path[i] AS src, path[i + 1] AS dst, count(*) AS n FROM first, range(1, 6) r(i) WHERE i <= hops GROUP BY ALL",
    "risk_spread": f"WITH {EDGE}, {RISK}, up AS (SELECT src AS address, max(risk) * 0.5 AS r FROM edge JOIN risk ON risk.address = edge.dst AND is_flagged GROUP BY 1) SELECT address, round(greatest(risk, r), 6) AS risk FROM risk LEFT JOIN up USING (address)",
    "group_risk": f"WITH {RISK}, top AS (SELECT cluster_id, max(risk) AS group_risk FROM risk WHERE cluster_id IS NOT NULL GROUP BY 1) SELECT address, cluster_id, round(group_risk, 6) AS group_risk, round(CASE WHEN group_risk > 0.5 THEN greatest(risk, group_risk * 0.7) ELSE risk END, 6) AS risk FROM risk LEFT JOIN top USING (cluster_id)",
    "neighbour_sample": f"WITH {EDGE} SELECT dst, src FROM edge QUALIFY row_number() OVER (PARTITION BY dst ORDER BY sha256('0|' || src || '|' || dst), src) <= 5",
    "neighbour_means": f"WITH {EDGE}, {RISK} SELECT dst AS address, round(avg(risk), 12) AS risk FROM edge JOIN risk ON risk.address = edge.src GROUP BY 1",
    "edge_index": f"WITH {EDGE}, num AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS id FROM (SELECT src AS a FROM edge UNION SELECT dst FROM edge)) SELECT s.id AS src_id, d.id AS dst_id FROM edge JOIN num s ON s.a = src JOIN num d ON d.a = dst",
    "chains_by_address": f"WITH {CHAINS} SELECT * FROM chains",
    "multi_chain_wallets": f"WITH {CHAINS} SELECT address, n_chains FROM chains WHERE n_chains > 1",
    "registry_hits": f"WITH {TX}{HITS} SELECT * FROM hits",
    "activity_boost": f"WITH {CHAINS}{HITS} SELECT address, CASE WHEN coalesce(bridge_hits, 0) > 0 AND n_chains > 1 THEN 1.4 WHEN coalesce(bridge_hits, 0) > 0 THEN 1.25 WHEN n_chains > 1 THEN 1.15 WHEN coalesce(staking_hits, 0) > 0 THEN 1.08 ELSE 1.0 END::DOUBLE AS boost FROM chains LEFT JOIN hits USING (address)",
    "running_chains": f"WITH {CHAINS}, since AS (SELECT address, chain, min(seq) AS s FROM side WHERE address IS NOT NULL AND chain IS NOT NULL GROUP BY 1, 2) SELECT tx.seq, tx.sender, count(*) AS chains_so_far FROM tx JOIN since ON since.address = tx.sender AND since.s <= tx.seq GROUP BY 1, 2",
    "chain_flags": f"WITH {_OBSERVED} SELECT seq, bridge, actor, asset, chains FROM obs",
    "chain_actors": f"WITH {_OBSERVED} SELECT * FROM act",
    "chain_stats": f"WITH {_OBSERVED} SELECT (SELECT count(*) FROM chains) AS wallets, (SELECT count(*) FROM chains WHERE n_chains > 1) AS multi_chain, (SELECT count(*) FROM act WHERE bridge_hits > 0) AS bridge_wallets, (SELECT coalesce(sum(bridge_hits), 0)::BIGINT FROM act) AS bridge_hits, (SELECT coalesce(sum(asset_hits), 0)::BIGINT FROM act) AS asset_hits, (SELECT count(bridge) FROM reg) AS known_bridges, (SELECT count(asset) FROM reg) AS known_assets",
    "sustained_hours": f"WITH {TX}, h AS (SELECT chain, block_timestamp // 3600 AS hour, count(*) AS n FROM tx GROUP BY 1, 2), high AS (SELECT chain, hour FROM h QUALIFY n > 0.5 * max(n) OVER (PARTITION BY chain)), r AS (SELECT chain, hour, hour - row_number() OVER (PARTITION BY chain ORDER BY hour) AS run FROM high) SELECT chain, min(hour) AS start, count(*) AS hours FROM r GROUP BY chain, run HAVING count(*) >= 3",
    "velocity_on_arrival": f"""WITH {NORM}, r AS (SELECT seq, sender, block_timestamp AS t, round(value_eth * 1e9)::HUGEINT AS v FROM norm WHERE sender IS NOT NULL),
e AS (SELECT a.seq, a.sender, a.t, a.v, min(b.seq) AS gone FROM r a LEFT JOIN r b ON b.sender = a.sender AND b.seq > a.seq AND b.t > a.t + 3600 GROUP BY ALL),
s AS (SELECT i.seq, i.t, count(*) AS n, sum(j.v) AS v, list_reverse_sort(list(j.t)) AS ts FROM r i JOIN e j ON j.sender = i.sender AND j.seq <= i.seq AND (j.gone IS NULL OR j.gone > i.seq) GROUP BY 1, 2)
SELECT seq, n AS tx_count, v::DOUBLE / 1e9 AS value_sum, CASE WHEN n > 1 THEN t - ts[2] ELSE -1 END::DOUBLE AS since_last FROM s""",
    "cross_chain_summary": f"WITH {CHAINS}{HITS} SELECT count(*) AS wallets, count(*) FILTER (n_chains > 1) AS multi_chain, (SELECT count(*) FROM hits WHERE bridge_hits > 0) AS bridge_users, (SELECT coalesce(sum(bridge_hits), 0)::BIGINT FROM hits) AS bridge_calls FROM chains",
    "calls_by_category": f"WITH {TX} SELECT coalesce(category, 'none') AS category, count(tx.seq) AS n FROM methods m LEFT JOIN tx ON tx.selector = lower(m.selector) GROUP BY 1",
    "watchlist_rows": f"WITH {TX}, {RISK} SELECT seq, sender FROM tx WHERE sender IN (SELECT address FROM risk WHERE is_flagged)",
    "unlisted_senders": f"WITH {TX}, {RISK} SELECT sender, count(*) AS n FROM tx WHERE sender IS NOT NULL AND sender NOT IN (SELECT address FROM risk) GROUP BY 1 HAVING count(*) >= 3",
    "top_senders": f"WITH {TX} SELECT sender, count(*) AS n FROM tx WHERE sender IS NOT NULL GROUP BY 1 ORDER BY n DESC, sender LIMIT 20",
    "rate_5m": f"WITH {TX} SELECT chain, block_timestamp // 300 * 300 AS start, count(*) AS n, round(count(*) / 300.0, 6)::DOUBLE AS rate FROM tx GROUP BY 1, 2",
    "mean_shift_24h": f"WITH {TX}, h AS (SELECT chain, block_timestamp // 3600 AS hour, avg(gas) AS mean FROM tx GROUP BY 1, 2) SELECT a.chain, a.hour, round(a.mean - b.mean, 3) AS shift FROM h a JOIN h b ON a.chain = b.chain AND a.hour = b.hour + 24",
    "le_buckets": f"WITH {TX} SELECT chain, le, count(*) AS n FROM tx, (VALUES " + ", ".join(f"('{b}', {b})" for b in GAS_BUCKETS) + ", ('+Inf', 9223372036854775807)) b(le, up) WHERE gas <= up GROUP BY 1, 2",
    "bucket_quantile": f"WITH {TX}, c AS (SELECT chain, count(gas) * 0.9::DOUBLE AS r FROM tx GROUP BY 1), b AS (SELECT chain, e.i, e.b AS up, count(*) FILTER (gas <= e.b) AS n FROM tx, (SELECT unnest(range(7)) AS i, unnest({[0, *GAS_BUCKETS]}) AS b) e GROUP BY ALL), w AS (SELECT b.*, r, coalesce(lag(up) OVER p, 0) AS low, coalesce(CASE WHEN lag(up) OVER p > 0 THEN lag(n) OVER p END, 0) AS below FROM b JOIN c USING (chain) WINDOW p AS (PARTITION BY chain ORDER BY i)) SELECT chain, round(coalesce(min(low + (up - low) * (r - below) / nullif(n - below, 0)) FILTER (i > 0 AND n >= r AND below < r), 1000000.0), 3)::DOUBLE AS p90 FROM w GROUP BY 1",
    "score_histogram": f"WITH {RISK}, b AS (SELECT is_flagged, {_BIN20} AS bin FROM risk WHERE risk BETWEEN 0 AND 1), d AS (SELECT DISTINCT is_flagged FROM risk) SELECT d.is_flagged, r.i::INT AS bin, count(b.bin) AS n FROM d CROSS JOIN range(20) r(i) LEFT JOIN b ON b.is_flagged = d.is_flagged AND b.bin = r.i GROUP BY 1, 2",
    "score_drift": f"""WITH b AS (SELECT {_BIN10} AS bin, coalesce(lower(chain_name) = 'polygon-mainnet', false) AS live FROM tx_features WHERE gas_price_percentile BETWEEN 0 AND 1),
p AS (SELECT i, greatest(count(*) FILTER (NOT live) / greatest((SELECT count(*) FROM b WHERE NOT live), 1), 1e-6) AS q, greatest(count(*) FILTER (live) / greatest((SELECT count(*) FROM b WHERE live), 1), 1e-6) AS l FROM range(10) r(i) LEFT JOIN b ON bin = i GROUP BY 1),
s AS (SELECT sum((l - q) * ln(l / q)) AS psi FROM p) SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS drift FROM s""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    "ranked_quality": f"WITH {_CURVE} SELECT round(coalesce(sum(p * up / (up + un)) / nullif(sum(p), 0), 0), 6) AS average_precision, round(coalesce(sum(n * (up - p / 2)) / nullif(sum(p) * sum(n), 0), 0), 6) AS roc_auc FROM curve",
    "precision_threshold": f"WITH {_CURVE} SELECT coalesce(min(risk), 0.5) AS threshold FROM curve WHERE up >= 0.3 * (up + un)",
}
