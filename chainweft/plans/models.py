"""Queries on features, models, scans, messages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.functions.identity import address, ether
from chainweft.functions.scalars import bounded_width, canonical_json, finite, flag, pad, top_by_size, unit
from chainweft.operators import alerts, crosschain, distribution, graph, learning, scanner, scoring, transactions, velocity
from chainweft.operators.rolling import DAY_S
from chainweft.operators.skew import lookup
from chainweft.plans.ledger import EDGE, ORACLES as LEDGER, TX, _GAP, _WIN, _tx
from chainweft.session import WrittenTables
from chainweft.sources import files, messages
from chainweft.sources.tables import table
from chainweft.streaming import pipelines

#: Contracts that show each rule of the scanner, one line of code to a line.
CONTRACTS = [
    "contract Till {\n  function take(uint n) public {\n    msg.sender.call{value: n}(\"\");\n    balances[msg.sender] -= n;\n  }\n}",
    "contract Late {\n  function pay(address to) external {\n    to.call.value(1)();\n  }\n}",
    "contract Draw {\n  function draw() public view returns (bool) {\n    require(block.timestamp > 9);\n    uint at = block.timestamp;\n  }\n}",
    "pragma solidity ^0.6.0;\ncontract Sum {\n  uint total;\n  function add(uint n) public {\n    total += n;\n  }\n}",
    "contract Send {\n  function send(address payable to) public {\n    to.send(1);\n    require(to.send(2));\n  }\n}",
    "contract End {\n  function stop() public onlyOwner {\n    selfdestruct(owner);\n  }\n}",
    "contract Gone {\n" + "  // filler\n" * 12 + "  selfdestruct(owner);\n}",
    "contract Calm {}",
]
COLUMNS = ["value_eth", "log_value_eth", "gas", "gas_price_gwei", "gas_price_percentile", "input_data_length", "tx_count_1h", "value_sum_1h", "time_since_last_tx", "address_in_degree", "address_out_degree"]


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tx_features")


#: The columns of a feature vector, in order.
VECTOR = ["value_eth", "log_value_eth", "is_high_value", "gas", "gas_price_gwei", "gas_price_percentile", "is_contract_call", "is_contract_creation", "input_data_length", "tx_count_1h", "tx_count_24h", "value_sum_1h", "time_since_last_tx", "address_in_degree", "address_out_degree", "cluster_risk_score"]


def feature_vectors(spark, folder):
    """The sixteen features of every distinct transaction in their order, computed from all of them; none is null.

    Figures by sender and by gas price are looked up, so that a sender with very many rows is joined apart.
    """
    columns = ["seq", "tx_hash", "sender", "recipient", "block_timestamp", "value_wei", "value_eth", "log_value_eth", "is_high_value", "gas", "gas_price_gwei", "input_length", "is_creation", "is_call", "chain"]
    tables = WrittenTables(spark, "features")
    tx, _ = tables.write(_tx(spark, folder, *columns))
    risk = graph.group_risk(_wallets(spark, folder).join(_clusters(spark, folder), "address"), "cluster_id").select("address", "group_risk")
    degree = graph.degrees(graph.edges(tx)).select("address", "in_degree", "out_degree")
    facts, _ = tables.write(degree.join(risk, "address", "full").withColumnRenamed("address", "sender"))
    shares, _ = tables.write(distribution.cumulative_share(tx.select("gas_price_gwei"), [], "gas_price_gwei"))
    many = tx.count()
    known, _ = tables.write(lookup(tx, facts, "sender", many))
    priced = lookup(known, shares, "gas_price_gwei", many)
    hour = velocity.recent_activity(priced, "sender", "block_timestamp", "seq", "value_wei").withColumnsRenamed({"tx_count": "tx_count_1h", "value_sum": "value_sum_1h", "since_last": "time_since_last_tx"}).drop("is_burst")
    rows = velocity.recent_activity(hour, "sender", "block_timestamp", "seq", "value_wei", DAY_S).drop("value_sum", "since_last", "is_burst")
    made = {
        "is_contract_call": flag(F.col("is_call")), "is_contract_creation": flag(F.col("is_creation")), "input_data_length": F.col("input_length"), "tx_count_24h": F.col("tx_count"), "value_sum_1h": ether(F.col("value_sum_1h")),
        "gas_price_percentile": F.coalesce("share", F.lit(0.5)), "address_in_degree": F.col("in_degree"), "address_out_degree": F.col("out_degree"), "cluster_risk_score": F.col("group_risk"),
    }
    return rows.select("seq", "tx_hash", "sender", "chain", *(F.round(F.coalesce(made.get(c, F.col(c)).cast("double"), F.lit(0.0)), 9).alias(c) for c in VECTOR))


def model_inputs(spark, folder):
    """Stored vectors as models take them: gaps filled, the first thirteen features kept, padded to the width of a network."""
    vector = F.array(*(finite(F.col(c)) for c in VECTOR))
    rows = _features(spark, folder).select("tx_hash", F.slice(vector, 1, 13).alias("kept"), pad(vector, files.FEATURES).alias("padded"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return rows.select("tx_hash", F.size("kept").alias("kept"), total("kept").alias("kept_sum"), F.size("padded").alias("padded"), total("padded").alias("padded_sum"))


def feature_moments(spark, folder):
    rows = learning.moments(_features(spark, folder), COLUMNS)
    return rows.select("feature", "n", *(F.round(c, 5).alias(c) for c in ("mean", "std", "low", "high")))


def class_separation(spark, folder):
    """How far each feature sets contract calls apart from the rest."""
    rows = learning.class_separation(_features(spark, folder).where(F.col("is_contract_call").isNotNull()), F.col("is_contract_call") == 1.0, COLUMNS)
    return rows.select("feature", *(F.round(c, 5).alias(c) for c in ("mean_true", "mean_false", "separation")), "suspicious")


def standardised(spark, folder):
    """Two features scaled by the training rows of a split that keeps the shares of the classes."""
    split = learning.stratified_split(_features(spark, folder), "tx_hash", "is_contract_call", 0.25)
    rows = learning.standardised(split, ["gas", "input_data_length"], split.where("split = 'train'"))
    return rows.select("tx_hash", F.round("gas", 5).alias("gas"), F.round("input_data_length", 5).alias("input_data_length"))


def min_max_scores(spark, folder):
    return learning.min_max(_features(spark, folder), "cluster_risk_score", "scaled").select("tx_hash", F.round("scaled", 6).alias("scaled"))


def class_weights(spark, folder):
    return learning.class_weights(_features(spark, folder), "is_contract_call").withColumn("weight", F.round("weight", 6))


def isolation_scores(spark, folder):
    """How easily each feature row is set apart."""
    scored = learning.isolation_scores(_features(spark, folder), "tx_hash", COLUMNS)
    return learning.flagged_outliers(scored, "score").select("tx_hash", "score", "scaled", "outlier")


def reconstruction_errors(spark, folder):
    """How far each row lies from the plane of the training rows."""
    rows = learning.stratified_split(_features(spark, folder), "tx_hash", "is_contract_call", 0.25)
    return learning.reconstruction_error(rows.where("split = 'train'"), rows, COLUMNS, 4).select("tx_hash", "split", "error")


def call_model(spark, folder):
    """Quality, on held-out rows, of a logistic model that tells contract calls from their other features."""
    inputs = [c for c in COLUMNS if c != "input_data_length"]
    rows = learning.stratified_split(_features(spark, folder).where(F.col("is_contract_call").isin(0.0, 1.0)), "tx_hash", "is_contract_call", 0.25)
    model = learning.logistic_model(rows.where("split = 'train'"), inputs, "is_contract_call")
    out = learning.predicted(model, rows.where("split = 'test'"), inputs)
    return distribution.ranked_quality(out, "probability", F.col("is_contract_call") == 1.0)


def call_model_folds(spark, folder):
    """Quality of that model in each of five folds, fitted on the other four."""
    inputs = [c for c in COLUMNS if c != "input_data_length"]
    return learning.cross_validated(_features(spark, folder).where(F.col("is_contract_call").isin(0.0, 1.0)), "tx_hash", inputs, "is_contract_call")


def split_sizes(spark, folder):
    """Rows of each class for training and test."""
    rows = learning.stratified_split(_features(spark, folder), "tx_hash", "is_contract_call", 0.25)
    return rows.groupBy("is_contract_call", "split").agg(F.count(F.lit(1)).alias("n"))


def call_model_reasons(spark, folder):
    """For each feature row, the three features that weigh most in that model's answer."""
    inputs = [c for c in COLUMNS if c != "input_data_length"]
    rows = _features(spark, folder).where(F.col("is_contract_call").isin(0.0, 1.0))
    out = learning.predicted(learning.logistic_model(rows, inputs, "is_contract_call"), rows, inputs)
    names = F.array(*map(F.lit, inputs))
    return out.select("tx_hash", "probability", F.concat_ws(",", F.transform(top_by_size(F.col("contributions"), 3), lambda e: F.element_at(names, e["index"] + 1))).alias("reasons"))


def nearest_vectors(spark, folder):
    """For each embedding whose number is divisible by 20, its nearest other one."""
    rows = table(spark, folder, "embeddings")
    found = learning.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding")
    return found.select("query", "neighbour", F.round("similarity", 6).alias("similarity"))


def source_findings(spark, folder):
    """Findings of the line rules in all documents."""
    return scanner.scan(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.inline("findings"))


def source_risk(spark, folder):
    """Risk of each document with findings."""
    return scanner.scan(table(spark, folder, "documents"), "doc_id", "text").where(F.size("findings") > 0).select("doc_id", F.size("findings").cast("long").alias("findings"), F.round("risk", 6).alias("risk"))


def findings_by_severity(spark, folder):
    """Findings by severity, severities without any included."""
    found = scanner.scan(table(spark, folder, "documents"), "doc_id", "text").select(F.inline("findings")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(s,) for s in scanner.SEVERITY], "severity string")
    return every.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def bytecode_risk(spark, folder):
    """Opcode features and risk of every input that is longer than a selector."""
    rows = table(spark, folder, "chain_tx").where(F.length("input_data") > 10)
    return scanner.bytecode_features(rows, "seq", "input_data").select("seq", "bytes", "selfdestruct", "delegatecall", "timestamp", "risk", F.concat_ws(",", "factors").alias("factors"))


def sample_findings(spark, folder):
    """Findings of all rules in contracts that show each of them."""
    rows = spark.createDataFrame(list(enumerate(CONTRACTS)), "doc_id long, text string")
    return scanner.scan(rows, "doc_id", "text").select("doc_id", F.inline("findings"))


def contract_risk(spark, folder):
    """The combined risk of contracts whose source and bytecode, where there are any, are a document and an input of its number."""
    sources = table(spark, folder, "documents").where(F.col("source").isin("scan_findings", "changelogs")).select("doc_id", "text")
    codes = table(spark, folder, "chain_tx").where(F.length("input_data") > 10).select(F.col("seq").alias("doc_id"), F.col("input_data").alias("code"))
    both = sources.join(codes, "doc_id", "full")
    return scanner.scan_contracts(both, "doc_id", "text", "code").select("doc_id", *(F.round(c, 6).alias(c) for c in ("source_risk", "bytecode_risk", "combined_risk")))


def payload_hash(spark, folder):
    """SHA-256 of the canonical JSON of each stored link."""
    rows = table(spark, folder, "wallet_links").select("link_id", "from_addr", "to_addr", "is_match")
    return rows.select("link_id", F.sha2(canonical_json(["link_id", "from_addr", "to_addr", "is_match"]), 256).alias("digest"))


def text_hash(spark, folder):
    """SHA-256 of the canonical JSON of each document."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return rows.select("doc_id", F.sha2(canonical_json(["doc_id", "lang", "source", "text"]), 256).alias("digest"))


def hex_quantities(spark, folder):
    """Amounts of all deliveries from the hexadecimal form in which nodes give them."""
    whole = F.lit(1 << 60).cast("decimal(20,0)")
    high = F.floor(F.col("value_wei") / whole).cast("long")
    low = (F.col("value_wei") % whole).cast("long")
    rows = table(spark, folder, "chain_tx").select("seq", F.concat(F.lit("0x"), F.hex(high), F.lpad(F.hex(low), 15, "0")).alias("value"))
    return rows.select("seq", files.quantity(F.col("value")).cast("string").alias("value_wei"))


def sampled_rows(spark, folder):
    """A repeatable quarter of one chain's deliveries and all of the others'."""
    return files.sampled(table(spark, folder, "chain_tx"), "seq", {"ethereum-sepolia": 0.25}).select("seq")


def topic_counts(spark, folder):
    """Messages by topic after a round trip through JSON, every hundredth of them cut short on the way."""
    sent = messages.to_messages(table(spark, folder, "chain_tx").withColumn("__cut", F.col("seq") % 100 == 0).withColumn("chain_name", F.when(F.col("__cut"), "cut").otherwise(F.col("chain_name"))))
    cut = F.when(F.col("value").contains('"chain_name":"cut"'), F.substring("value", 1, 40)).otherwise(F.col("value"))
    good, bad = messages.from_messages(sent.withColumn("value", cut))
    counts = good.groupBy(messages.topic(F.col("chain_name")).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("value_wei").cast("double").alias("value_wei"))
    return counts.unionByName(bad.groupBy(F.lit("corrupt").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("value_wei")))


def last_links(spark, folder):
    """The five newest links of each kind of evidence."""
    rows = table(spark, folder, "wallet_links").select("link_id", F.coalesce("evidence", F.lit("none")).alias("evidence"))
    return messages.newest(rows, ["evidence"], "link_id", 5)


def latest_links(spark, folder):
    """The latest verdict on each ordered pair and how often it was replaced."""
    rows = table(spark, folder, "wallet_links").where(F.col("from_addr").isNotNull() & F.col("to_addr").isNotNull())
    pair = F.concat_ws(">", F.lower("from_addr"), F.lower("to_addr"))
    return rows.groupBy(pair.alias("pair")).agg(F.max(F.struct("link_id", "is_match"))["is_match"].alias("is_match"), (F.count(F.lit(1)) - 1).alias("updates"))


def _assessments(spark, folder):
    links = table(spark, folder, "wallet_links")
    value = table(spark, folder, "wallets").select(F.lower("address").alias("key"), F.col("total_value_eth").alias("value"))
    label = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.6, "middle").otherwise("low")
    rows = links.select(address(F.col("from_addr")).alias("key"), F.col("link_id").alias("order"), F.unix_timestamp("linked_at").alias("at"), "score", label.alias("label"))
    return rows.join(value, "key", "left")


def current_alerts(spark, folder):
    """The current assessment of each wallet that matching put first, and what came before."""
    rows = alerts.current_alerts(_assessments(spark, folder))
    return rows.select("key", "score", "label", "created_at", "updated_at", "update_count", F.round("raw_priority", 9).alias("raw_priority"))


def top_alerts(spark, folder):
    """The fifty alerts of highest priority as of the newest one."""
    rows = _assessments(spark, folder)
    now = F.lit(rows.agg(F.max("at")).first()[0] or 0)
    return alerts.top_alerts(alerts.current_alerts(rows), now, 50).select("key", F.round("priority", 9).alias("priority"))


def alert_counts(spark, folder):
    """Active alerts by label, labels without any included, and how many were created and updated."""
    return alerts.alert_counts(alerts.current_alerts(_assessments(spark, folder)), ["high", "middle", "low", "none"])


_WEIGHTS = {"percentile": 0.5, "cluster": 0.3, "activity": 0.2}
_STEPS = [(0.6, "high"), (0.4, "middle")]


def combined_scores(spark, folder):
    """A weighted mean of three scores of each feature row, of which some are missing, with its label and agreement."""
    scores = {"percentile": F.nanvl("gas_price_percentile", F.lit(None).cast("double")), "cluster": F.nanvl("cluster_risk_score", F.lit(None).cast("double")), "activity": F.least(F.lit(1.0), F.nanvl("tx_count_1h", F.lit(None).cast("double")) / 20)}
    score = scoring.combined(scores, _WEIGHTS)
    return _features(spark, folder).select("tx_hash", F.round(score, 10).alias("score"), scoring.label(F.round(score, 10), _STEPS, "low").alias("label"), F.round(scoring.agreement(list(scores.values())), 10).alias("agreement"), scoring.leading(scores).alias("leading"))


def decayed_links(spark, folder):
    """The hundred links of highest score, decayed by a tenth for each day before the newest link."""
    rows = table(spark, folder, "wallet_links").where(F.col("score").isNotNull() & F.col("linked_at").isNotNull())
    age = rows.agg(F.max(F.unix_timestamp("linked_at"))).scalar() - F.unix_timestamp("linked_at")
    ranked = rows.select("link_id", F.round(scoring.decayed(F.col("score"), age, 0.9, 86400.0, 3600.0), 9).alias("priority"))
    return ranked.orderBy(F.desc("priority"), "link_id").limit(100)


def kept_links(spark, folder):
    """At most two hundred links: those with evidence of a shared deposit, then the highest scores."""
    rows = table(spark, folder, "wallet_links").where(F.col("score").isNotNull()).select("link_id", "evidence", "score")
    return scoring.kept(rows, (F.col("evidence") == "shared_deposit") & (F.col("score") > 0.9), F.col("score"), "link_id", 200)


def _wallets(spark, folder):
    return table(spark, folder, "wallets").select(F.lower("address").alias("address"), F.col("risk_score").alias("risk"), F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"))


def _clusters(spark, folder):
    return table(spark, folder, "wallets").select(F.lower("address").alias("address"), "cluster_id")


def wallet_report(spark, folder):
    """For every stored wallet its totals, degrees, round trips within a day and chains, in one row."""
    columns = ["seq", "sender", "recipient", "value_wei", "block_timestamp", "chain"]
    tx, _ = WrittenTables(spark, "report").write(_tx(spark, folder, *columns))
    edge = graph.edges(tx)
    trips = graph.round_trips(edge).groupBy("address").agg(F.count(F.lit(1)).alias("round_trips"))
    rows = _wallets(spark, folder).join(graph.wallet_totals(tx), "address", "left").join(graph.degrees(edge), "address", "left").join(trips, "address", "left").join(crosschain.chains_by_address(tx), "address", "left")
    zero = F.lit(0).cast("long")
    return rows.select("address", F.round("risk", 6).alias("risk"), "is_flagged", *(F.coalesce(c, zero).alias(c) for c in ("tx_count", "out_degree", "in_degree", "round_trips", "n_chains")), F.round(F.coalesce("total_value_eth", F.lit(0.0)), 9).alias("total_value_eth"), F.round(F.coalesce("centrality", F.lit(0.0)), 6).alias("centrality"))


def scored_transactions(spark, folder):
    """Every distinct transaction scored from its features, its sender's stored risk and its sender's activity."""
    features, _ = WrittenTables(spark, "scored").write(feature_vectors(spark, folder).select("seq", "sender", "chain", "tx_count_1h", F.col("address_in_degree").alias("in_degree"), F.col("address_out_degree").alias("out_degree")))
    rows = lookup(features, _wallets(spark, folder).select(F.col("address").alias("sender"), "risk"), "sender", features.count())
    scores = {"risk": F.col("risk"), "centrality": F.least(F.lit(1.0), (F.col("in_degree") + F.col("out_degree")) / 100.0), "velocity": F.least(F.lit(1.0), F.col("tx_count_1h") / 20.0)}
    score = F.round(scoring.combined(scores, {"risk": 0.5, "centrality": 0.3, "velocity": 0.2}), 10)
    return rows.select("seq", "sender", "chain", score.alias("score"), scoring.label(score, [(0.6, "high"), (0.3, "middle")], "low").alias("label"))


def scores_by_label(spark, folder):
    """Scored transactions and their mean score by chain and label, labels without any included."""
    rows = scored_transactions(spark, folder)
    counts = rows.groupBy("chain", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    labels = F.explode(F.array(*map(F.lit, ["high", "middle", "low"]))).alias("label")
    every = table(spark, folder, "chain_tx").select(F.lower(F.trim("chain_name")).alias("chain")).distinct().select("chain", labels)
    return every.join(counts, ["chain", "label"], "left").select("chain", "label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 8).alias("mean"))


def neighbour_labels(spark, folder):
    """For each embedding whose number is divisible by 20, its own label and that of its nearest other one."""
    rows = table(spark, folder, "embeddings")
    found = learning.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding").select("query", "neighbour")
    own = rows.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    other = rows.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("near"))
    return found.join(own, "query").join(other, "neighbour").select("query", "own", "near")


def unit_vectors(spark, folder):
    """The five largest entries of each embedding made a unit vector."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.inline(top_by_size(unit(F.col("embedding")), 5)))
    return rows.select("vec_id", F.col("index").cast("long").alias("index"), F.round("value", 6).alias("value"))


def drawing_widths(spark, folder):
    """Edge widths and node sizes for drawing the graph of matched links."""
    rows = table(spark, folder, "wallet_links").where(F.col("score").isNotNull())
    return rows.select("link_id", F.round(bounded_width(F.col("score"), 4.0), 6).alias("width"), (15 + F.floor(25 * F.col("score"))).alias("size"))


def stream_velocity(spark, folder):
    """``velocity_on_arrival`` as a stream."""
    rows = transactions.normalise(pipelines.stream_of(spark, folder, "chain_tx", "seq"))
    return pipelines.run_to_end(pipelines.velocity(rows), partitions=2 * spark.sparkContext.defaultParallelism)


def stream_distinct(spark, folder):
    """The hashes that a stream lets through; repeats come up to twenty days after."""
    rows = pipelines.stream_of(spark, folder, "chain_tx", "seq").withColumn("at", F.timestamp_seconds("block_timestamp"))
    kept = pipelines.run_to_end(pipelines.distinct_messages(rows, "tx_hash", "at", "20 days"))
    return transactions.normalise(kept).select("tx_hash")


def _chain_times(spark, folder):
    return pipelines.stream_of(spark, folder, "chain_tx", "seq").select(F.timestamp_seconds("block_timestamp").alias("at"), F.lower(F.trim("chain_name")).alias("chain"))


def stream_rates(spark, folder):
    """Deliveries by chain and day of block time, from a stream."""
    counts = pipelines.run_to_end(pipelines.windowed_counts(_chain_times(spark, folder), "at", "chain", "1 day", "20 days"), "complete")
    return counts.select("chain", F.unix_timestamp("start").alias("start"), "n")


def stream_sessions(spark, folder):
    """Runs of deliveries of a chain with no gap of ten minutes, from a stream."""
    runs = pipelines.run_to_end(pipelines.sessions(_chain_times(spark, folder), "at", "chain", "10 minutes", "20 days"), "complete")
    return runs.select("chain", F.unix_timestamp("start").alias("start"), (F.unix_timestamp("end") - 600).alias("last"), "n")


def _pairs(spark, folder):
    rows = pipelines.stream_of(spark, folder, "wallet_links", "link_id").where(F.col("from_addr").isNotNull() & F.col("to_addr").isNotNull())
    return rows.withColumn("pair", F.concat_ws(">", F.lower("from_addr"), F.lower("to_addr"))).withColumn("verdict", F.struct("is_match"))


def stream_latest(spark, folder):
    """``latest_links`` as a stream."""
    rows = pipelines.run_to_end(pipelines.latest_state(_pairs(spark, folder), "pair", "link_id", "verdict"), "update", ["pair"])
    return rows.select("pair", "verdict.is_match", "updates")


def stream_last_scores(spark, folder):
    """The five newest scores of each kind of evidence, from a stream."""
    rows = pipelines.stream_of(spark, folder, "wallet_links", "link_id").withColumn("kind", F.coalesce("evidence", F.lit("none")))
    last = pipelines.run_to_end(pipelines.last_scores(rows, "kind", "link_id", "score", "linked_at", 5, delay="200 days"), "update", ["kind"])
    return last.select("kind", "upto", F.concat_ws(",", F.transform("scores", lambda x: F.round(x * 10000).cast("long").cast("string"))).alias("scores"))


_NAMES = [feature_vectors, feature_moments, class_separation, standardised, min_max_scores, class_weights, isolation_scores, reconstruction_errors, call_model, call_model_folds, split_sizes, call_model_reasons, model_inputs, sample_findings, contract_risk, text_hash, hex_quantities, sampled_rows, current_alerts, top_alerts, alert_counts, nearest_vectors, source_findings, source_risk, findings_by_severity, bytecode_risk, payload_hash, topic_counts, last_links, latest_links, combined_scores, decayed_links, kept_links, wallet_report, scored_transactions, scores_by_label, neighbour_labels, unit_vectors, drawing_widths, stream_velocity, stream_distinct, stream_rates, stream_sessions, stream_latest, stream_last_scores]
QUERIES = {f.__name__: f for f in _NAMES}

_X = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_MOMENTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_X.format(c)} AS x, is_contract_call = 1.0 AS y FROM tx_features" for c in COLUMNS)
_RULE = "SELECT doc_id, '{0}' AS rule, {1} AS severity, i::INT AS line, {2}::DOUBLE AS confidence FROM ln WHERE {3}"
_re = lambda p: "'" + p.replace("'", "''") + "'"
_FINDINGS = f"""raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 0),
flat AS (SELECT doc_id, text, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM raw),
ln AS (SELECT *, string_agg(x, chr(10)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a5, string_agg(x, chr(10)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS a20, string_agg(x, chr(10)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b10 FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
found AS (""" + " UNION ALL ".join(
    [_RULE.format("REENTRANCY", "'CRITICAL'", f"CASE WHEN coalesce(regexp_matches(a5, {_re(scanner.STATE_UPDATE)}), false) THEN 0.9 ELSE 0.65 END", f"regexp_matches(x, {_re(p)})") for p in scanner.CALLS]
    + [
        _RULE.format("TIMESTAMP_DEPENDENCY", f"CASE WHEN regexp_matches(x, {_re(scanner.CRITICAL_USE)}) THEN 'MEDIUM' ELSE 'LOW' END", "0.8", f"regexp_matches(x, {_re(scanner.TIMESTAMP)})"),
        _RULE.format("ACCESS_CONTROL", "'HIGH'", "0.7", f"regexp_matches(x, {_re(scanner.OPEN_FUNCTION)}) AND regexp_extract(x, {_re(scanner.OPEN_FUNCTION)}, 1) NOT IN ('constructor', 'fallback', 'receive') AND regexp_matches(a20, {_re(scanner.STATE_CHANGE)}) AND NOT regexp_matches(a20, {_re(scanner.PROTECTED)})"),
        _RULE.format("INTEGER_OVERFLOW", "'HIGH'", "0.85", f"regexp_matches(text, {_re(scanner.OLD_COMPILER)}) AND NOT contains(text, 'SafeMath') AND regexp_matches(x, {_re(scanner.ARITHMETIC)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1"),
        _RULE.format("UNCHECKED_RETURN", "'MEDIUM'", "0.75", f"regexp_matches(x, {_re(scanner.SEND)}) AND NOT regexp_matches(x, {_re(scanner.CHECKED)})"),
        _RULE.format("SELFDESTRUCT", f"CASE WHEN regexp_matches(b10, {_re(scanner.OWNER_ONLY)}) THEN 'LOW' ELSE 'CRITICAL' END", "0.95", f"regexp_matches(x, {_re(scanner.DESTROY)})"),
    ]
) + ")"
_SCORE = "CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.25 ELSE 0.1 END"

_VECTORS = f"""{EDGE}, d AS (SELECT address, sum(o) AS o, sum(i) AS i FROM (SELECT src AS address, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) GROUP BY 1),
top AS (SELECT cluster_id, max(risk_score) AS r FROM wallets WHERE cluster_id IS NOT NULL GROUP BY 1), own AS (SELECT lower(address) AS address, top.r FROM wallets JOIN top USING (cluster_id)),
v AS (SELECT *, count(*) {_WIN.format(3600)} AS c, count(*) {_WIN.format(86400)} AS c24, sum(value_wei) {_WIN.format(3600)} AS s, {_GAP} AS gap FROM tx WHERE sender IS NOT NULL),
price AS (SELECT DISTINCT gas_price_gwei, cume_dist() OVER (ORDER BY gas_price_gwei) AS share FROM tx WHERE gas_price_gwei IS NOT NULL),
f AS (SELECT seq, tx_hash, sender, chain, value_eth, log_value_eth, is_high_value, gas, gas_price_gwei, coalesce(share, 0.5) AS gas_price_percentile, is_call::INT AS is_contract_call, is_creation::INT AS is_contract_creation, input_length AS input_data_length,
 c AS tx_count_1h, c24 AS tx_count_24h, s::DECIMAL(38,0)::DOUBLE / 1e18 AS value_sum_1h, CASE WHEN gap <= 3600 THEN gap ELSE -1 END AS time_since_last_tx, i AS address_in_degree, o AS address_out_degree, own.r AS cluster_risk_score
 FROM v LEFT JOIN d ON d.address = v.sender LEFT JOIN own ON own.address = v.sender LEFT JOIN price USING (gas_price_gwei))"""
_SPLIT = "SELECT *, CASE WHEN row_number() OVER (PARTITION BY is_contract_call ORDER BY sha256('0|' || tx_hash)) <= floor(count(*) OVER (PARTITION BY is_contract_call) * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS split FROM tx_features"
_ESCAPED = """coalesce('"' || array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' OR c = chr(92) THEN chr(92) || c WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(13) THEN chr(92) || 'r' WHEN c = chr(9) THEN chr(92) || 't' WHEN c = chr(8) THEN chr(92) || 'b' WHEN c = chr(12) THEN chr(92) || 'f'
 WHEN unicode(c) > 65535 THEN chr(92) || 'u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || chr(92) || 'u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) WHEN unicode(c) < 32 OR unicode(c) > 126 THEN chr(92) || 'u' || printf('%04x', unicode(c)) ELSE c END), '') || '"', 'null')"""
_OPS = "|".join(f"{0x60 + n:02x}.{{0,{2 * n + 2}}}" for n in range(32)) + "|.."
_CODE = f"""code AS (SELECT seq, CASE WHEN regexp_full_match(h, '([0-9a-f]{{2}})*') THEN h ELSE '' END AS h FROM (SELECT seq, substr(x, 1, length(x) // 2 * 2) AS h FROM (SELECT seq, lower(replace(replace(input_data, '0x', ''), ' ', '')) AS x FROM chain_tx WHERE length(input_data) > 10))),
ops AS (SELECT seq, length(h) // 2 AS bytes, list_transform(regexp_extract_all(h, '{_OPS}'), lambda x: x[1:2]) AS o FROM code),
sign AS (SELECT seq, bytes, list_contains(o, 'ff') AS selfdestruct, list_contains(o, 'f4') AS delegatecall, list_contains(o, '42') AS timestamp, len(list_filter(o, lambda x: x = 'f1')) / greatest(bytes, 1) > 0.02 AS calls, len(list_filter(o, lambda x: x = '55')) / greatest(bytes, 1) > 0.05 AS stores FROM ops),
byte_risk AS (SELECT *, round(least(1.0, selfdestruct::INT * 0.3::DOUBLE + delegatecall::INT * 0.25::DOUBLE + calls::INT * 0.2::DOUBLE + timestamp::INT * 0.1::DOUBLE + stores::INT * 0.1::DOUBLE + (bytes > 20000)::INT * 0.05::DOUBLE), 4) AS risk,
 concat_ws(',', CASE WHEN selfdestruct THEN 'selfdestruct' END, CASE WHEN delegatecall THEN 'delegatecall' END, CASE WHEN calls THEN 'call_frequency' END, CASE WHEN timestamp THEN 'timestamp' END, CASE WHEN stores THEN 'sstore_frequency' END, CASE WHEN bytes > 20000 THEN 'size' END) AS factors FROM sign)"""
_SAMPLES = "documents AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '" + text.replace("'", "''") + "')" for k, text in enumerate(CONTRACTS)) + ") c(doc_id, text))"
_ALERTS = """a AS (SELECT CASE WHEN length(trim(from_addr)) > 0 THEN lower(trim(from_addr)) END AS key, link_id, epoch(linked_at)::BIGINT AS at_s, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.6 THEN 'middle' ELSE 'low' END AS label FROM wallet_links),
state AS (SELECT key, max(link_id) AS l, arg_min(at_s, link_id) AS created_at, count(*) - 1 AS update_count FROM a WHERE key IS NOT NULL GROUP BY 1),
cur AS (SELECT s.key, a.score, a.label, s.created_at, a.at_s AS updated_at, s.update_count, coalesce(a.score, 0) * ln(coalesce(w.total_value_eth, 0) + 2) AS raw_priority FROM state s JOIN a ON a.link_id = s.l LEFT JOIN wallets w ON lower(w.address) = s.key)"""

_FEATURES = f"""{_VECTORS},
s AS (SELECT f.seq, f.sender, f.chain, w.risk_score AS r, least(1.0, (coalesce(address_in_degree, 0) + coalesce(address_out_degree, 0)) / 100.0::DOUBLE) AS cen, least(1.0, tx_count_1h / 20.0::DOUBLE) AS vel FROM f LEFT JOIN wallets w ON lower(w.address) = f.sender),
scored AS (SELECT seq, sender, chain, round((coalesce(r * 0.5, 0) + cen * 0.3 + vel * 0.2) / (CASE WHEN r >= 0 THEN 0.5 ELSE 0 END + 0.3::DOUBLE + 0.2::DOUBLE), 10) AS score FROM s),
labelled AS (SELECT *, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'middle' ELSE 'low' END AS label FROM scored)"""

ORACLES = {
    "wallet_report": f"WITH {EDGE}, side AS (SELECT chain, sender AS address FROM tx UNION ALL SELECT chain, recipient FROM tx), ch AS (SELECT address, count(DISTINCT chain) AS n_chains FROM side WHERE address IS NOT NULL GROUP BY 1), d AS (SELECT address, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM (SELECT src AS address, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) GROUP BY 1), st AS (SELECT sender AS address, count(*) AS n, sum(value_wei)::DECIMAL(38,0)::DOUBLE / 1e18 AS v FROM tx WHERE recipient IS NOT NULL GROUP BY 1), rt AS (SELECT o.src AS address, count(*) AS k FROM edge o JOIN edge b ON b.src = o.dst AND b.dst = o.src WHERE b.last_time - o.last_time > 0 AND b.last_time - o.last_time < 86400 GROUP BY 1) SELECT lower(w.address) AS address, round(risk_score, 6) AS risk, coalesce(is_flagged, false) AS is_flagged, coalesce(st.n, 0) AS tx_count, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(k, 0) AS round_trips, coalesce(n_chains, 0) AS n_chains, round(coalesce(st.v, 0.0), 9)::DOUBLE AS total_value_eth, round(CASE WHEN o IS NULL THEN 0.0 ELSE least(1.0, (o + i) / 100.0::DOUBLE) END, 6)::DOUBLE AS centrality FROM wallets w LEFT JOIN st ON st.address = lower(w.address) LEFT JOIN d ON d.address = lower(w.address) LEFT JOIN rt ON rt.address = lower(w.address) LEFT JOIN ch ON ch.address = lower(w.address)",
    "scored_transactions": f"WITH {_FEATURES} SELECT * FROM labelled",
    "scores_by_label": f"WITH {_FEATURES} SELECT c.chain, l.label, count(x.seq) AS n, round(coalesce(avg(x.score), 0), 8) AS mean FROM (SELECT DISTINCT lower(trim(chain_name)) AS chain FROM chain_tx) c CROSS JOIN (VALUES ('high'), ('middle'), ('low')) l(label) LEFT JOIN labelled x ON x.chain = c.chain AND x.label = l.label GROUP BY 1, 2",
    "neighbour_labels": "WITH n AS (SELECT q.vec_id AS query, q.label AS own, arg_min(r.label, (-round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 12), r.vec_id)) AS near FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id GROUP BY 1, 2) SELECT * FROM n",
    "unit_vectors": "WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x)) + 1e-8 AS len FROM e GROUP BY 1) SELECT vec_id, i::BIGINT AS index, round(x / len, 6) AS value FROM e JOIN n USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) <= 5",
    "drawing_widths": "SELECT link_id, round(least(5.0, greatest(1.0, score * 4)), 6)::DOUBLE AS width, (15 + floor(25 * score))::BIGINT AS size FROM wallet_links WHERE score IS NOT NULL",
    "feature_vectors": f"WITH {_VECTORS} SELECT seq, tx_hash, sender, chain, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 9) AS {c}" for c in VECTOR) + " FROM f",
    "model_inputs": "WITH x AS (SELECT tx_hash, [" + ", ".join(f"CASE WHEN isnan({c}) OR isinf({c}) OR {c} IS NULL THEN 0.0 ELSE {c} END" for c in VECTOR) + "] AS v FROM tx_features) SELECT tx_hash, 13 AS kept, round(list_sum(v[1:13]), 4) AS kept_sum, 165 AS padded, round(list_sum(v), 4) AS padded_sum FROM x",
    "split_sizes": f"SELECT is_contract_call, split, count(*) AS n FROM ({_SPLIT}) GROUP BY 1, 2",
    "sample_findings": f"WITH {_SAMPLES}, {_FINDINGS} SELECT doc_id, rule, severity, line, confidence FROM found",
    "bytecode_risk": f"WITH {_CODE} SELECT seq, bytes, selfdestruct, delegatecall, timestamp, risk, factors FROM byte_risk",
    "contract_risk": f"WITH all_docs AS (SELECT doc_id, text FROM documents WHERE source IN ('scan_findings', 'changelogs')), {_FINDINGS.replace('FROM documents', 'FROM all_docs')}, {_CODE}, source_risk AS (SELECT doc_id, round(0.7 * max({_SCORE}) + 0.3 * avg({_SCORE}), 6)::DOUBLE AS r FROM found GROUP BY 1) SELECT coalesce(d.doc_id, b.seq) AS doc_id, CASE WHEN length(d.text) > 0 THEN coalesce(s.r, 0.0) END AS source_risk, b.risk AS bytecode_risk, coalesce(greatest(CASE WHEN length(d.text) > 0 THEN coalesce(s.r, 0.0) END, b.risk), 0.0) AS combined_risk FROM all_docs d LEFT JOIN source_risk s USING (doc_id) FULL JOIN byte_risk b ON b.seq = d.doc_id",
    "text_hash": "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || " + _ESCAPED.format("lang") + " || ',\"source\":' || " + _ESCAPED.format("source") + " || ',\"text\":' || " + _ESCAPED.format("text") + " || '}') AS digest FROM documents",
    "hex_quantities": "SELECT seq, value_wei::VARCHAR AS value_wei FROM chain_tx",
    "sampled_rows": "SELECT seq FROM chain_tx WHERE lower(trim(chain_name)) IS DISTINCT FROM 'ethereum-sepolia' OR ('0x' || substr(sha256('0|' || seq), 1, 8))::BIGINT < 0.25 * 4294967296.0",
    "current_alerts": f"WITH {_ALERTS} SELECT key, score, label, created_at, updated_at, update_count, round(raw_priority, 9) AS raw_priority FROM cur",
    "top_alerts": f"WITH {_ALERTS} SELECT key, round(raw_priority * pow(0.9, greatest(0.0, ((SELECT max(at_s) FROM a) - updated_at - 3600) / 3600.0)), 9) AS priority FROM cur ORDER BY raw_priority * pow(0.9, greatest(0.0, ((SELECT max(at_s) FROM a) - updated_at - 3600) / 3600.0)) DESC, key LIMIT 50",
    "alert_counts": f"WITH {_ALERTS} SELECT l.label, count(cur.key) AS active, (SELECT count(*) FROM cur) AS created, (SELECT coalesce(sum(update_count), 0)::BIGINT FROM cur) AS deduplicated FROM (VALUES ('high'), ('middle'), ('low'), ('none')) l(label) LEFT JOIN cur USING (label) GROUP BY 1",
    "stream_velocity": LEDGER["velocity_on_arrival"],
    "stream_sessions": "WITH g AS (SELECT lower(trim(chain_name)) AS chain, block_timestamp AS t, CASE WHEN block_timestamp - lag(block_timestamp) OVER (PARTITION BY lower(trim(chain_name)) ORDER BY block_timestamp) <= 600 THEN 0 ELSE 1 END AS fresh FROM chain_tx), r AS (SELECT chain, t, sum(fresh) OVER (PARTITION BY chain ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT chain, min(t) AS start, max(t) AS last, count(*) AS n FROM r GROUP BY chain, run",
    "stream_last_scores": "WITH r AS (SELECT coalesce(evidence, 'none') AS kind, link_id, score FROM wallet_links WHERE score IS NOT NULL AND linked_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(evidence, 'none') ORDER BY link_id DESC) <= 5) SELECT kind, max(link_id) AS upto, string_agg(round(score * 10000)::BIGINT::VARCHAR, ',' ORDER BY link_id) AS scores FROM r GROUP BY 1",
    "feature_moments": f"WITH x AS ({_MOMENTS}) SELECT feature, count(x) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 5) AS low, round(max(x), 5) AS high FROM x GROUP BY 1",
    "class_separation": f"WITH x AS ({_MOMENTS}), s AS (SELECT feature, avg(x) FILTER (y) AS t, avg(x) FILTER (NOT y) AS f, abs(avg(x) FILTER (y) - avg(x) FILTER (NOT y)) / (stddev_pop(x) + 1e-9) AS sep FROM x WHERE y IS NOT NULL GROUP BY 1) SELECT feature, round(t, 5) AS mean_true, round(f, 5) AS mean_false, round(sep, 5) AS separation, sep > 2.5 AS suspicious FROM s",
    "standardised": f"WITH x AS (SELECT tx_hash, split, {_X.format('gas')} AS g, {_X.format('input_data_length')} AS l FROM ({_SPLIT})), m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(l) AS ml, stddev_pop(l) AS sl FROM x WHERE split = 'train') SELECT tx_hash, round((coalesce(g, mg) - mg) / sg, 5) AS gas, round((coalesce(l, ml) - ml) / sl, 5) AS input_data_length FROM x, m",
    "min_max_scores": f"WITH x AS (SELECT tx_hash, {_X.format('cluster_risk_score')} AS c FROM tx_features), m AS (SELECT min(c) AS a, max(c) AS z FROM x) SELECT tx_hash, round((c - a) / (z - a), 6) AS scaled FROM x, m",
    "class_weights": "WITH c AS (SELECT is_contract_call, count(*) AS n FROM tx_features WHERE is_contract_call IS NOT NULL GROUP BY 1) SELECT is_contract_call, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
    "nearest_vectors": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS len FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS other, round(list_inner_product(q.v, r.v) / q.len / r.len, 12) AS c FROM e q, e r WHERE q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id) SELECT query, arg_min(other, (-c, other)) AS neighbour, round(max(c), 6) AS similarity FROM s GROUP BY 1",
    "source_findings": f"WITH {_FINDINGS} SELECT doc_id, rule, severity, line, confidence FROM found",
    "source_risk": f"WITH {_FINDINGS} SELECT doc_id, count(*) AS findings, round(0.7 * max({_SCORE}) + 0.3 * avg({_SCORE}), 6)::DOUBLE AS risk FROM found GROUP BY 1",
    "findings_by_severity": f"WITH {_FINDINGS} SELECT s.severity, count(f.severity) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN found f USING (severity) GROUP BY 1",
    "payload_hash": """SELECT link_id, sha256('{"from_addr":' || coalesce('"' || from_addr || '"', 'null') || ',"is_match":' || coalesce(is_match::VARCHAR, 'null') || ',"link_id":' || link_id || ',"to_addr":' || coalesce('"' || to_addr || '"', 'null') || '}') AS digest FROM wallet_links""",
    "topic_counts": "SELECT CASE WHEN seq % 100 = 0 THEN 'corrupt' WHEN lower(trim(chain_name)) = 'polygon-mainnet' THEN 'raw.transactions.polygon' ELSE 'raw.transactions.ethereum' END AS topic, count(*) AS n, CASE WHEN min(seq % 100) > 0 THEN sum(value_wei)::DECIMAL(38,0)::DOUBLE END AS value_wei FROM chain_tx GROUP BY 1",
    "last_links": "SELECT link_id, coalesce(evidence, 'none') AS evidence FROM wallet_links QUALIFY row_number() OVER (PARTITION BY coalesce(evidence, 'none') ORDER BY link_id DESC) <= 5",
    "latest_links": "SELECT lower(from_addr) || '>' || lower(to_addr) AS pair, last(is_match ORDER BY link_id) AS is_match, count(*) - 1 AS updates FROM wallet_links WHERE from_addr IS NOT NULL AND to_addr IS NOT NULL GROUP BY 1",
    "combined_scores": f"""WITH x AS (SELECT tx_hash, CASE WHEN p >= 0 THEN p END AS p, CASE WHEN c >= 0 THEN c END AS c, CASE WHEN a >= 0 THEN a END AS a FROM (SELECT tx_hash, {_X.format('gas_price_percentile')} AS p, {_X.format('cluster_risk_score')} AS c, CASE WHEN {_X.format('tx_count_1h')} IS NULL THEN 1.0 ELSE least(1.0, tx_count_1h / 20) END AS a FROM tx_features)),
s AS (SELECT *, round(coalesce((coalesce(p * 0.5, 0) + coalesce(c * 0.3, 0) + coalesce(a * 0.2, 0)) / nullif((p IS NOT NULL)::INT * 0.5::DOUBLE + (c IS NOT NULL)::INT * 0.3::DOUBLE + (a IS NOT NULL)::INT * 0.2::DOUBLE, 0), 0), 10) AS score, (coalesce(p, 0) + coalesce(c, 0) + coalesce(a, 0)) / nullif((p IS NOT NULL)::INT + (c IS NOT NULL)::INT + (a IS NOT NULL)::INT, 0) AS mean FROM x)
SELECT tx_hash, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'middle' ELSE 'low' END AS label,
round(coalesce((coalesce(((p >= 0.5) = (mean >= 0.5))::INT, 0) + coalesce(((c >= 0.5) = (mean >= 0.5))::INT, 0) + coalesce(((a >= 0.5) = (mean >= 0.5))::INT, 0)) / nullif((p IS NOT NULL)::INT + (c IS NOT NULL)::INT + (a IS NOT NULL)::INT, 0), 0), 10) AS agreement,
CASE greatest(p, c, a) WHEN p THEN 'percentile' WHEN c THEN 'cluster' WHEN a THEN 'activity' END AS leading FROM s""",
    "decayed_links": "SELECT link_id, round(score * pow(0.9, greatest(0.0, ((SELECT max(epoch(linked_at)::BIGINT) FROM wallet_links WHERE score IS NOT NULL) - epoch(linked_at)::BIGINT - 3600) / 86400.0)), 9) AS priority FROM wallet_links WHERE score IS NOT NULL AND linked_at IS NOT NULL ORDER BY priority DESC, link_id LIMIT 100",
    "kept_links": "WITH r AS (SELECT link_id, evidence, score, coalesce(evidence = 'shared_deposit' AND score > 0.9, false) AS safe FROM wallet_links WHERE score IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY score DESC, link_id) AS n, count(*) FILTER (safe) OVER () AS many FROM r) SELECT link_id, evidence, score FROM k WHERE safe OR n <= greatest(0, 200 - many)",
    "stream_distinct": f"WITH {TX} SELECT tx_hash FROM tx",
    "stream_rates": "SELECT lower(trim(chain_name)) AS chain, block_timestamp // 86400 * 86400 AS start, count(*) AS n FROM chain_tx GROUP BY 1, 2",
    "stream_latest": "SELECT lower(from_addr) || '>' || lower(to_addr) AS pair, last(is_match ORDER BY link_id) AS is_match, count(*) - 1 AS updates FROM wallet_links WHERE from_addr IS NOT NULL AND to_addr IS NOT NULL GROUP BY 1",
}
