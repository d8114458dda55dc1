"""Readers and writers of the other file forms: benchmark CSVs, address lists, sampled and per-chain sources.

Defined cases: a missing list is empty. Lines and entries that aren't addresses are skipped. Null chains are sampled
at rate 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.functions.identity import chain

FEATURES = 165


def benchmark_features(spark: SparkSession, path: str, features: int = FEATURES) -> DataFrame:
    """The header-less feature file: txId, time_step and numbered features."""
    schema = T.StructType([T.StructField("txId", T.LongType()), T.StructField("time_step", T.IntegerType()), *(T.StructField(f"feat_{k}", T.DoubleType()) for k in range(1, features + 1))])
    return spark.read.schema(schema).csv(path)


def benchmark_classes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("txId long, class string").option("header", True).csv(path)


def benchmark_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("txId1 long, txId2 long").option("header", True).csv(path)


def labelled(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Features with ``label`` 1, 2 or 0 for unknown, also where there is no class."""
    label = F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 2).otherwise(0)
    return features.join(classes, "txId", "left").withColumn("label", label).drop("class")


def chronological(rows: DataFrame, last_train: int = 34, last: int = 49) -> DataFrame:
    """``rows`` up to the last step, with ``split`` by time step."""
    return rows.where(F.col("time_step").between(1, last)).withColumn("split", F.when(F.col("time_step") <= last_train, "train").otherwise("test"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both known."""
    ids = nodes.select("txId")
    return edges.join(ids.withColumnRenamed("txId", "txId1"), "txId1", "left_semi").join(ids.withColumnRenamed("txId", "txId2"), "txId2", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def address_json(spark: SparkSession, path: str) -> DataFrame:
    """(address) from ``{"addresses": [...]}``, lower-case and distinct."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "address string")
    rows = spark.read.schema("addresses array<string>").option("multiLine", True).json(path)
    return rows.select(F.explode("addresses").alias("address")).select(F.lower(F.trim("address")).alias("address")).where(F.length("address") > 0).distinct()


def address_lines(spark: SparkSession, path: str) -> DataFrame:
    """(address) from a text with an address on some lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("address")).where(F.col("address").startswith("0x")).distinct()


def address_entries(spark: SparkSession, path: str) -> DataFrame:
    """(address) from a JSON array of objects with an address."""
    rows = spark.read.schema("address string").option("multiLine", True).json(path)
    return rows.select(F.lower(F.trim("address")).alias("address")).where(F.col("address").startswith("0x")).distinct()


def merged_lists(*lists: DataFrame) -> DataFrame:
    """The distinct addresses of all lists, in order."""
    return reduce(DataFrame.unionByName, lists).distinct().orderBy("address")


def sampled(rows: DataFrame, ident: str, rates: dict[str, float], seed: int = 0) -> DataFrame:
    """A repeatable Bernoulli sample by chain: the identifier's seeded hash decides."""
    rate = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), chain(F.col("chain_name"))), F.lit(1.0))
    place = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return rows.where(place < rate * 2.0**32)


def by_chain(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the named chains, as one table."""
    return reduce(DataFrame.unionByName, [rows.where(chain(F.col("chain_name")) == n) for n in names])


def quantity(c: Column) -> Column:
    """A hexadecimal quantity with ``0x`` as decimal(38,0); null where it isn't one or has more than 38 digits."""
    digits = F.regexp_extract(c, "^0[xX]0*([0-9a-fA-F]+)$", 1)
    padded = F.lpad(digits, 32, "0")
    total = F.lit(0).cast("decimal(38,0)")
    for k in range(4):  # 32 bits each, as ``conv`` counts to 64
        piece = F.conv(F.substring(padded, 8 * k + 1, 8), 16, 10).cast("decimal(10,0)")
        shifted = F.try_multiply(total, F.lit(1 << 32).cast("decimal(10,0)")) if k else total
        total = F.try_add(shifted.cast("decimal(38,0)"), piece).cast("decimal(38,0)")
    return F.when(F.length(digits).between(1, 32), total)


def raw_transaction(rows: DataFrame) -> DataFrame:
    """Decodes hexadecimal quantities and ISO times of node responses (hash, from, to, value, gas, time)."""
    return rows.select("hash", "from", "to", quantity(F.col("value")).alias("value_wei"), quantity(F.col("gas")).cast("long").alias("gas"), F.unix_timestamp(F.to_timestamp("time")).alias("block_timestamp"))


def save_processed(rows: DataFrame, folder: str, ident: str, columns: list[str], label: str, split: str) -> None:
    """Writes feature arrays with labels, by split, and beside them the names of the features and counts of rows."""
    kept = rows.select(F.col(ident).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("features"), F.col(label).alias("label"), F.col(split).alias("split"))
    kept.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/rows")
    kept.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.lit(columns).alias("names")).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def save_baseline(scores: DataFrame, score: str, path: str) -> None:
    """Writes the counts of scores rounded to six places, from which any histogram of them can be made."""
    known = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    known.groupBy(F.round(score, 6).alias("score")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(score, n) as saved; empty if there is none."""
    return spark.read.schema("score double, n long").json(path) if _exists(spark, path) else spark.createDataFrame([], "score double, n long")
