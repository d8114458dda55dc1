"""Transaction messages: JSON payloads, topics by chain, dead letters and their replay.

Defined cases: a message that isn't JSON of the schema goes to the corrupt side with its text; a null message too.
Rows of unknown chains go to the default topic. Nothing is dropped: good and corrupt messages make up the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.functions.identity import chain

# Topics by chain, and the one for all others.
TOPICS = {"ethereum-sepolia": "raw.transactions.ethereum", "polygon-mainnet": "raw.transactions.polygon"}
DEFAULT_TOPIC = "raw.transactions.ethereum"

PAYLOAD = T.StructType(
    [T.StructField(n, t) for n, t in [("tx_hash", T.StringType()), ("block_number", T.LongType()), ("block_timestamp", T.LongType()), ("from_addr", T.StringType()), ("to_addr", T.StringType()), ("value_wei", T.DecimalType(38, 0)), ("gas", T.LongType()), ("gas_price", T.LongType()), ("is_contract_creation", T.BooleanType()), ("is_contract_call", T.BooleanType()), ("chain_id", T.IntegerType()), ("chain_name", T.StringType())]]
)
CORRUPT = "_corrupt_record"


def topic(name: Column) -> Column:
    choice = F.create_map(*(F.lit(x) for pair in TOPICS.items() for x in pair))
    return F.coalesce(F.try_element_at(choice, chain(name)), F.lit(DEFAULT_TOPIC))


def to_messages(rows: DataFrame) -> DataFrame:
    """(topic, key, value): the payload of each row as JSON, keyed by sender."""
    return rows.select(topic(F.col("chain_name")).alias("topic"), F.col("from_addr").alias("key"), F.to_json(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PAYLOAD))).alias("value"))


def from_messages(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): parsed payloads, and (value) of the messages that can't be parsed."""
    schema = T.StructType([*PAYLOAD.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = messages.withColumn("__p", F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("__p").isNull() | F.col(f"__p.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("__p.*").drop(CORRUPT), parsed.where(bad).select(F.col(value).alias("value"))


def write_topics(messages: DataFrame, folder: str) -> None:
    """Appends messages to one folder for each topic; the stand-in for a broker where there is none."""
    messages.write.mode("append").partitionBy("topic").json(folder)


def write_kafka(messages: DataFrame, servers: str) -> None:
    """Sends messages to a broker, acknowledged by all replicas and without duplicates from retries."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.linger.ms", "10").save()


def alert_messages(alerts: DataFrame, severity: str, key: str, payload: list[str]) -> DataFrame:
    """(topic, key, value) of alerts: critical ones have their own topic, all others go to the one for high ones."""
    rank = F.when(F.lower(severity) == "critical", "critical").otherwise("high")
    return alerts.select(F.concat(F.lit("alerts."), rank).alias("topic"), F.col(key).alias("key"), F.to_json(F.struct(*payload)).alias("value"))


def deliver(batch: DataFrame, sink: Callable[[DataFrame], None], dead_letters: str, most: int = 10_000) -> bool:
    """Sends a batch; if that fails, keeps its messages as dead letters, the newest ``most`` of them all.

    ``batch`` has (seq, topic, key, value). The limit on dead letters is the feature. Returns whether the sink took it.
    """
    try:
        sink(batch)
        return True
    except Exception:  # noqa: BLE001 - whatever the sink raises, messages must be kept
        mine = batch.select("seq", "topic", "key", "value")
        old = letters(batch.sparkSession, dead_letters)
        every = mine if old is None else old.unionByName(mine)
        _replace(every.orderBy(F.desc("seq")).limit(most), dead_letters)
        return False


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions of a table that were written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def letters(spark: SparkSession, folder: str) -> DataFrame | None:
    """The dead letters kept in a folder; None if there never were any."""
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/{versions[-1]}") if versions else None


def _replace(rows: DataFrame, folder: str) -> None:
    """Writes the next version; it counts once it is complete, and only then do older ones go, so a crash loses nothing."""
    spark = rows.sparkSession
    old = _versions(spark, folder)
    rows.write.mode("overwrite").parquet(f"{folder}/{old[-1] + 1 if old else 0}")
    for version in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replay(spark: SparkSession, sink: Callable[[DataFrame], None], dead_letters: str, step: int = 1000) -> int:
    """Sends the dead letters again, oldest first in steps, up to the first step that fails; returns how many were taken.

    Those taken are dropped after each step, so a crash repeats one step at most.
    """
    taken = 0
    while (rest := letters(spark, dead_letters)) is not None:
        batch = rest.orderBy("seq").limit(step)
        many = batch.count()
        if not many:
            break
        try:
            sink(batch)
        except Exception:  # noqa: BLE001 - what the sink didn't take stays
            break
        taken += many
        last = batch.agg(F.max("seq")).first()[0]
        _replace(rest.where(F.col("seq") > last), dead_letters)
    return taken


def newest(rows: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each group, as a ring buffer keeps them."""
    by = Window.partitionBy(*group).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= most).drop("__k")
