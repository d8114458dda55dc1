"""Queries p1, p2, p4 and p5 on the transaction tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.functions.identity import address, ether, event_type
from chainweft.operators.dedup import first_messages, repeated_messages
from chainweft.operators.entity_features import entity_features
from chainweft.operators.heavy_keys import heavy_hitters, per_key
from chainweft.operators.rolling import daily_activity, rolling_totals
from chainweft.sources.tables import table

FIRST_DAY, DAYS = date(2025, 3, 1), 90
#: Totals are equal if they are no further apart than this part of the larger one.
TOTAL_TOLERANCE = 1e-9
AVERAGE_TOLERANCE = 1e-6
HEAVY_SHARE = 0.015
#: Most addresses that are broadcast to leave out other senders early, about 100 bytes each.
MOST_WANTED = 300_000


def distinct_events(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, type, time, value) of every distinct transaction."""
    rows = table(spark, folder, "chain_tx").select("tx_hash", "seq", address(F.col("from_addr")).alias("entity"), event_type(F.col("input_data")).alias("type"), F.col("block_timestamp").alias("time"), F.col("value_wei").alias("value"))
    return first_messages(rows, "tx_hash", "seq", ["entity", "type", "time", "value"])


def p1_features(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row for each sending wallet; ``types`` is an array of figures by event type, in order of type."""
    wide = entity_features(distinct_events(spark, folder))
    per_type = F.transform(
        F.array_sort(F.map_entries("types")),
        lambda e: F.concat_ws(":", e["key"], e["value"]["n"].cast("string"), e["value"]["total"].cast("string"), e["value"]["first"].cast("string"), e["value"]["last"].cast("string")),
    )
    return wide.select(F.col("entity").alias("address"), F.col("n").alias("tx_count"), F.round(ether(F.col("total")), 9).alias("total_value_eth"), F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), F.size("types").cast("long").alias("n_types"), F.concat_ws(",", per_type).alias("by_type"))


def _differs(stored: Column, n: Column, total: Column, first: Column, last: Column) -> Column:
    """Whether a stored summary differs from the figures; null differs from everything but null."""
    value = stored["total_value_eth"]
    apart = ~F.coalesce(F.abs(value - total) <= F.greatest(F.abs(value), F.abs(total)) * TOTAL_TOLERANCE, F.lit(False))
    return ~stored["tx_count"].eqNullSafe(n) | apart | ~stored["first_seen"].eqNullSafe(first.cast("double")) | ~stored["last_seen"].eqNullSafe(last.cast("double"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored summaries that differ from the figures of the feature table, by wallet or by wallet and event type."""
    summary = F.struct("tx_count", "total_value_eth", "first_seen", "last_seen")
    wallets = table(spark, folder, "wallets").where(F.col("tx_count").isNotNull()).select(address(F.col("address")).alias("address"), summary.alias("s"), F.lit(None).cast("string").alias("selector"))
    methods = table(spark, folder, "wallet_methods").select(address(F.col("address")).alias("address"), summary.alias("s"), F.lower("selector").alias("selector"))
    stored = wallets.unionByName(methods).groupBy("address").agg(
        F.collect_set(F.when(F.col("selector").isNull(), F.col("s"))).alias("whole"),
        F.collect_set(F.when(F.col("selector").isNotNull(), F.struct("selector", "s"))).alias("parts"),
    )
    wide = entity_features(distinct_events(spark, folder)).withColumnRenamed("entity", "address")
    both = stored.join(wide, "address", "left")
    none = F.lit(0).cast("long")
    bad_whole = F.exists("whole", lambda s: _differs(s, F.coalesce("n", none), F.coalesce(ether(F.col("total")), F.lit(0.0)), F.col("first"), F.col("last")))
    figures = lambda p: F.try_element_at("types", p["selector"])
    bad_parts = F.filter("parts", lambda p: figures(p).isNull() | _differs(p["s"], figures(p)["n"], ether(figures(p)["total"]), figures(p)["first"], figures(p)["last"]))
    missing = F.when(F.size("parts") > 0, F.array_except(F.map_keys("types"), F.transform("parts", lambda p: p["selector"])))
    empty = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(F.when(bad_whole, F.array(F.lit("*"))).otherwise(empty), F.transform(bad_parts, lambda p: p["selector"]), F.coalesce(missing, empty)))
    return both.select("address", F.explode(found).alias("selector"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days of ``daily_totals`` that are missing or wrong."""
    stored = table(spark, folder, "daily_totals").withColumn("entity", address(F.col("address"))).drop("address")
    wanted = stored.select("entity").where(F.col("entity").isNotNull()).distinct()
    sent = distinct_events(spark, folder).select("entity", "time", "value")
    if wanted.count() <= MOST_WANTED:  # else every sender's days are made, which are compact, and joined afterwards
        sent = sent.join(F.broadcast(wanted), "entity", "left_semi")
    actual = rolling_totals(daily_activity(sent), wanted, FIRST_DAY, DAYS)
    pairs = actual.join(stored.withColumn("there", F.lit(True)), ["entity", "day"], "left")
    apart = ~F.coalesce(F.abs(F.col("avg_tx_30d") - F.col("n_30d") / 30.0) <= AVERAGE_TOLERANCE, F.lit(False))
    same = [("tx_count_7d", "n_7d"), ("value_wei_7d", "total_7d"), ("tx_count_30d", "n_30d"), ("value_wei_30d", "total_30d"), ("peak_tx_count_1h", "peak")]
    wrong = F.col("there").isNull() | apart
    for kept, made in same:
        wrong = wrong | ~F.col(kept).eqNullSafe(F.col(made))
    return pairs.where(wrong).select(F.col("entity").alias("address"), F.date_format("day", "yyyy-MM-dd").alias("day")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery beyond the first of its hash."""
    return repeated_messages(table(spark, folder, "chain_tx"), "tx_hash", "seq")


def _sides() -> dict[str, Column]:
    return {"from": address(F.col("from_addr")), "to": address(F.col("to_addr"))}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that hold at least 1.5 percent of the deliveries on a side."""
    heavy = heavy_hitters(table(spark, folder, "chain_tx"), _sides(), HEAVY_SHARE)
    return heavy.select("side", F.col("key").alias("address"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries, value and gas of each sender and each recipient."""
    rows = per_key(table(spark, folder, "chain_tx"), _sides(), {"value_wei": F.col("value_wei"), "gas": F.col("gas")})
    return rows.where(F.length("key") > 0).select("side", F.col("key").alias("address"), F.col("rows").alias("n"), F.round(ether(F.col("value_wei")), 9).alias("value_eth"), F.col("gas").alias("gas"))


QUERIES = {"p1_found": p1_found, "p1_features": p1_features, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_totals": p5_totals}

_HASH = "regexp_replace(lower(trim(tx_hash)), '^0x', '')"
_ADDRESS = "CASE WHEN length(regexp_replace(lower(trim({0})), '^0x', '')) > 0 THEN '0x' || regexp_replace(lower(trim({0})), '^0x', '') END"
_TX = f"""
first AS (SELECT arg_min(rowid_, seq) AS r FROM (SELECT seq, seq AS rowid_, {_HASH} AS h FROM chain_tx) GROUP BY h),
tx AS (SELECT {_ADDRESS.format('from_addr')} AS address,
  CASE WHEN length(input_data) >= 10 THEN lower(left(input_data, 10)) ELSE '0x' END AS selector,
  block_timestamp AS t, value_wei AS v FROM chain_tx WHERE seq IN (SELECT r FROM first))"""
_STATS = "count(*) AS n, sum(v)::DECIMAL(38,0)::DOUBLE / 1e18 AS total, min(t) AS first_t, max(t) AS last_t"
_APART = """(s.tx_count IS DISTINCT FROM {n} OR s.first_seen IS DISTINCT FROM a.first_t::DOUBLE OR s.last_seen IS DISTINCT FROM a.last_t::DOUBLE
 OR coalesce(abs(s.total_value_eth - {total}) > greatest(abs(s.total_value_eth), abs({total})) * 1e-9, true))"""

ORACLES = {
    "p1_found": f"""WITH {_TX},
whole AS (SELECT address, {_STATS} FROM tx GROUP BY 1), part AS (SELECT address, selector, {_STATS} FROM tx GROUP BY 1, 2)
SELECT lower(s.address) AS address, '*' AS selector FROM wallets s LEFT JOIN whole a ON a.address = lower(s.address)
WHERE s.tx_count IS NOT NULL AND {_APART.format(n='coalesce(a.n, 0)', total='coalesce(a.total, 0)')}
UNION
SELECT coalesce(a.address, lower(s.address)), coalesce(a.selector, s.selector)
FROM (SELECT * FROM part WHERE address IN (SELECT lower(address) FROM wallet_methods)) a
FULL JOIN wallet_methods s ON a.address = lower(s.address) AND a.selector = s.selector
WHERE a.address IS NULL OR s.address IS NULL OR {_APART.format(n='a.n', total='a.total')}""",
    "p1_features": f"""WITH {_TX}, part AS (SELECT address, selector, count(*) AS n, sum(v)::DECIMAL(38,0) AS total, min(t) AS a, max(t) AS z FROM tx WHERE address IS NOT NULL GROUP BY 1, 2)
SELECT address, sum(n)::BIGINT AS tx_count, round(sum(total)::DECIMAL(38,0)::DOUBLE / 1e18, 9) AS total_value_eth, min(a) AS first_seen, max(z) AS last_seen,
count(*) AS n_types, string_agg(concat_ws(':', selector, n, total, a, z), ',' ORDER BY selector) AS by_type FROM part GROUP BY 1""",
    "p2_found": f"""WITH {_TX}, wanted AS (SELECT DISTINCT lower(address) AS address FROM daily_totals),
sent AS (SELECT address, t, v, t // 86400 AS d FROM tx WHERE address IN (SELECT address FROM wanted)),
velocity AS (SELECT address, d, v, count(*) OVER (PARTITION BY address ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS c FROM sent),
daily AS (SELECT address, d, count(*) AS n, sum(v) AS v, max(c) AS peak FROM velocity GROUP BY 1, 2),
days AS (SELECT address, DATE '2025-03-01' + i::INTEGER AS day, 20148 + i AS d FROM wanted, range(90) r(i)),
filled AS (SELECT address, day, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(peak, 0) AS peak FROM days LEFT JOIN daily USING (address, d)),
trail AS (SELECT address, day, peak,
  sum(n) OVER w7 AS n7, sum(v) OVER w7 AS v7, sum(n) OVER w30 AS n30, sum(v) OVER w30 AS v30 FROM filled
  WINDOW w7 AS (PARTITION BY address ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY address ORDER BY day ROWS 29 PRECEDING))
SELECT DISTINCT a.address, strftime(a.day, '%Y-%m-%d') AS day FROM trail a LEFT JOIN daily_totals s ON lower(s.address) = a.address AND s.day = a.day
WHERE s.address IS NULL OR s.tx_count_7d IS DISTINCT FROM n7 OR s.value_wei_7d IS DISTINCT FROM v7 OR s.tx_count_30d IS DISTINCT FROM n30
OR s.value_wei_30d IS DISTINCT FROM v30 OR s.peak_tx_count_1h IS DISTINCT FROM a.peak OR coalesce(abs(s.avg_tx_30d - n30 / 30.0) > 1e-6, true)""",
    "p4_found": f"SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY {_HASH} ORDER BY seq) AS k, {_HASH} AS h FROM chain_tx) WHERE k > 1 AND h IS NOT NULL",
    "p5_found": f"""WITH k AS (SELECT 'from' AS side, {_ADDRESS.format('from_addr')} AS address FROM chain_tx UNION ALL SELECT 'to', {_ADDRESS.format('to_addr')} FROM chain_tx)
SELECT side, address FROM k WHERE address IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.015 * (SELECT count(*) FROM chain_tx)""",
    "p5_totals": f"""WITH k AS (SELECT 'from' AS side, {_ADDRESS.format('from_addr')} AS address, value_wei, gas FROM chain_tx UNION ALL SELECT 'to', {_ADDRESS.format('to_addr')}, value_wei, gas FROM chain_tx)
SELECT side, address, count(*) AS n, round(sum(value_wei)::DECIMAL(38,0)::DOUBLE / 1e18, 9) AS value_eth, sum(gas)::BIGINT AS gas FROM k WHERE address IS NOT NULL GROUP BY 1, 2""",
}
