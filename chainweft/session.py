"""Session helpers: building a session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The setting that names the folder all executors share.
SHARED_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chainweft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: the session's own setting, or one made for this process in local mode.

    On a cluster the setting must name storage that every executor reaches; without it this raises.
    """
    own = spark.conf.get(SHARED_DIR, None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="chainweft-")
        spark.conf.set(SHARED_DIR, own)
    return own.rstrip("/")


#: Folders of tables that were written and not yet deleted.
_ROOTS: dict[str, SparkSession] = {}


def release(spark: SparkSession | None = None) -> None:
    """Deletes all tables that queries of a session (or any) have written; call it once their results have been read."""
    for root, owner in list(_ROOTS.items()):
        if spark is None or owner is spark:
            del _ROOTS[root]
            try:
                _delete(owner, root)
            except (Py4JError, OSError) as error:  # the JVM may have ended before
                logging.getLogger(__name__).info("%s was not deleted: %s", root, error)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)


class WrittenTables:
    """Tables written to shared storage to cut lineage; unlike cached blocks they outlive a lost executor.

    They last until ``release`` or the end of the process, as results that read them are evaluated later.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _ROOTS[self.root] = spark

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Writes ``df`` and returns it as read back, with its path."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Deletes a table that nothing reads any more."""
        _delete(self.spark, path)
