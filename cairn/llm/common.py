"""Helpers shared by the training-data operators: the shared folder, written intermediates, text rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space code points that separate words in every contract here.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_FOLDER = "file:///tmp/checkpoints/cairn"


class _Written(threading.local):
    """Folders that this thread has written and not yet removed, oldest first: what one thread releases, no other one reads."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this machine
    will do if the executors run in this process; on a cluster they would not see each other's files, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or _OWN_FOLDER).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone; the folder is scratch space
        pass


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and the files
    outlive the executors that wrote them. The folder is removed by ``release``, or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``release``: the number of folders that this thread has written and not yet removed."""
    return len(_written.paths)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the folders that this thread has written since the mark, but for the last ``keep``; nothing may read them any more."""
    gone = _written.paths[since : len(_written.paths) - keep]
    del _written.paths[since : len(_written.paths) - keep]
    for path in gone:
        _remove(spark, path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores put behind it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_rows(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct, ``row``: names of our own beside it clash with none of the caller's.
    ``select("row.*")`` gives the columns back."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"))


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def field(column: str) -> str:
    """The name of a column inside ``row``."""
    return "row." + quoted(column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def _trim() -> None:
    """Hand freed memory back to the system, where the C library can; elsewhere its own rules do."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(run: Callable) -> Callable:
    """A worker's generator that hands unused memory back when it ends, Arrow's and the C library's: idle workers live on
    for later stages, beside a JVM that has grown."""

    @functools.wraps(run)
    def out(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return out
