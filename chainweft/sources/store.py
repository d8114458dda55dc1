"""A table of saved alerts: appended, numbered, looked up and counted.

Rows are appended as parquet; numbers go on from the highest one, in the order of a column, by a distributed prefix sum.
Appends from several writers at once must be kept apart by the caller, as with any table without transactions.

Defined cases: a store without rows is empty, not an error. Null times come last in the order of time and are in no period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.operators.distribution import dense_numbers

SCHEMA = "id long, key string, severity string, score double, created_at long, acknowledged boolean"


class AlertStore:
    """Alerts (id, key, severity, score, created_at, acknowledged) in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def save(self, alerts: DataFrame, order: str) -> None:
        """Appends alerts with further numbers in the order of a column that tells them apart."""
        last = self.rows().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbers = dense_numbers(alerts, order, "__n")
        numbered = alerts.join(numbers, order).withColumn("id", F.col("__n") + last + 1).withColumn("acknowledged", F.lit(False))
        numbered.select("id", "key", "severity", "score", "created_at", "acknowledged").write.mode("append").parquet(self.folder)

    def recent(self, n: int, severity: str | None = None) -> DataFrame:
        """The newest ``n`` alerts, of one severity or any."""
        rows = self.rows() if severity is None else self.rows().where(F.col("severity") == severity)
        return rows.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(n)

    def history(self, keys: DataFrame) -> DataFrame:
        """All alerts of the given keys (key)."""
        return self.rows().join(keys.select("key").distinct(), "key", "left_semi")

    def statistics(self, now_s: int, severities: list[str]) -> DataFrame:
        """(severity, total, last_day): alerts of each severity, also those without any, and under null all of them."""
        day = F.col("created_at").between(now_s - 86400, now_s)
        counts = self.rows().groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count_if(day).alias("last_day"))
        every = self.spark.createDataFrame([(s,) for s in severities], "severity string").join(F.broadcast(counts), "severity", "left")
        whole = self.rows().agg(F.lit(None).cast("string").alias("severity"), F.count(F.lit(1)).alias("total"), F.count_if(day).alias("last_day"))
        return every.select("severity", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "last_day"))).unionByName(whole)
