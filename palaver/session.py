"""Session factory and table access shared by every query."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(cpus: str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for: UTC, AQE, Arrow transfer."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palaver")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table, read lazily: filters and column lists reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the session has cores: a table of a few small files is dealt out, any other is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


#: Rows of a partition of a table that is dealt out by its size.
PARTITION_ROWS = 500_000


def sized(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by these columns to partitions of about PARTITION_ROWS of its ``rows``, so that a task's memory does not grow with the table; as it is where the session's cores take it whole in such parts."""
    parts = -(-rows // PARTITION_ROWS)
    return df.repartition(parts, *by) if parts > df.sparkSession.sparkContext.defaultParallelism else df


_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which all executors share.

    It is spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given. Where none is named a
    folder is made here once, in local mode only: another machine could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    of = spark.sparkContext.applicationId
    if of not in _made:
        _made[of] = tempfile.mkdtemp(prefix=f"palaver-{os.getpid()}-")
    return _made[of]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to; one that is not there is no error."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a side that is broadcast without another bound.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows, which are counted; else as it is, for Spark to join by shuffle or in blocks."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is a folder."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
