"""Named parquet tables of one data folder, read through Spark only."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``folder``, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(scan: DataFrame) -> DataFrame:
    """A table as it was read, dealt out anew if it has fewer parts than there are cores, for steps that take long for each row.

    That is a small table; one of more parts stays as it lies.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to as many parts as the session's setting says, before a join on it: the join needs the same exchange, but small parts aren't put together, so that long steps after it use all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that go when the driver ends: in the checkpoint folder that all executors share, or a local one where the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptloom-checkpoint-"))
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has gone; the folder's owner cleans it
        pass


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to a table of ``scratch`` and read back: its lineage is cut, and it survives lost executors."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
