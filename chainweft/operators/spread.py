"""Spreading a small input over all cores before work that takes long for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out to all cores if its files are too few to occupy half of them, else as they are.

    Files count by the pieces in which they are read, so what is shuffled is less than the size of a piece for each
    core; large inputs are never shuffled. Rows that don't come from files stay as they are.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows._jdf.inputFiles()  # stays in the JVM, as there may be very many
    if not 0 < len(files) < cores / 2:
        return rows
    conf = spark._jsc.hadoopConfiguration()
    size = 0
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    piece = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return rows.repartition(cores) if size / piece < cores / 2 else rows
