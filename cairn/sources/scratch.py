"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER = "file:///tmp/checkpoints/cairn"


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = file_system(spark, path)
        fs.delete(where, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset and the executors
    run in this process, a folder of this machine. Removed when the driver's Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(folder or _OWN_FOLDER).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def file_states(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files of a table: another value where the table has been written again."""
    fs, where = file_system(spark, path)
    listed = fs.listFiles(where, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a partition is dealt.
DEAL = 10_000


def spread(df: DataFrame, rows: int = DEAL) -> DataFrame:
    """``df``, a table as read, in even partitions of some ``rows`` rows, as many as there are cores at least. It stays as it is where its rows lie in that many
    already. Partitions alone say little: a file is cut by bytes, but all rows of a row group come with one of its cuts, and executors may still
    be on their way when cores are counted. So rows are counted, which takes the files' footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [n for (n,) in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect()]  # one number a partition
    if len(held) >= cores and max(held) <= 4 * rows:
        return df
    return df.repartition(max(cores, -(-sum(held) // rows)))


def spread_by(df: DataFrame, key: str, rows: int = 10 * DEAL) -> DataFrame:
    """``df``, a table as read, dealt by ``key`` in partitions of some ``rows`` rows, as many as there are cores at least."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)
