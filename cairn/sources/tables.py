"""Sources and sinks: workspaces, chunk tables, JSON lines, caches."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.sources.scratch import materialize
from cairn.functions.text import INDEX_LANGUAGES, detect_language, is_test_file_pat, output_preview, workspace_relative

# Folders that are never read, and the size beyond which a file is not.
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode")
TEST_SKIP_DIRS = ("node_modules", ".venv", "venv", "__pycache__", ".git", ".ai_index", ".ai_cache", "dist", "build", ".next", ".nuxt", ".svelte-kit")
MAX_FILE = 1024 * 1024

AUDIT = "ts double, session_id string, tool_name string, success boolean, duration_ms double, output_preview string"


def workspace_files(listing: DataFrame, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """Of a listing (path relative, length, ...) the files that are indexed."""
    inside = F.size(F.array_intersect(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, skip)))) == 0
    return listing.filter(inside & (F.col("length") <= MAX_FILE)).withColumn("language", detect_language(F.col("path"))).filter("language <> 'unknown'")


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime, content, language) of a workspace. Sizes and extensions are pushed to the file source."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise ValueError(f"no workspace at {root}")
    base = fs.getFileStatus(where).getPath().toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(INDEX_LANGUAGES) + "}").load(root).filter(F.col("length") <= MAX_FILE)
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    rel = F.when(F.startswith(full, F.lit(base + "/")), F.substr(full, F.lit(len(base) + 2))).otherwise(full)
    # bytes that are no UTF-8 are replaced, as editors do
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return workspace_files(raw.select(rel.alias("path"), "length", F.col("modificationTime").alias("mtime"), text.alias("content")))


def scan_test_files(listing: DataFrame, most: int = 500) -> DataFrame:
    """Test files of a listing (path), in path order; the report ends at ``most``."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    clean = (F.size(F.array_intersect(dirs, F.array(*map(F.lit, TEST_SKIP_DIRS)))) == 0) & ~F.exists(dirs, lambda d: d.startswith("."))
    return listing.filter(clean).withColumn("kind", is_test_file_pat(F.col("path"))).filter("kind is not null").orderBy("path").limit(most)


def reorder_priority(files: DataFrame, first: list[str], order: str) -> DataFrame:
    """``files`` with ``place``: the files of ``first`` in that order, then the rest in theirs."""
    unique = list(dict.fromkeys(first))
    rank = F.array_position(F.array(*map(F.lit, unique)), F.col("path")) if unique else F.lit(0)
    return files.withColumn("place", F.struct((rank == 0).cast("int").alias("rest"), F.when(rank == 0, F.lit(0)).otherwise(rank).alias("rank"), F.col(order).alias("n")))


def number_rows(rows: DataFrame, order: str, out: str) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in the order given, without bringing them into one task. Rows are dealt by ranges of the order and
    written; each range's rows are numbered by a window of their own, and added to the count of those before it."""
    spread = rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    spread = materialize(spread, "ranges")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a range
    inside = F.row_number().over(W.partitionBy("__part").orderBy(order))
    return spread.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(out, F.col("__in") + F.col("before")).drop("__part", "__in", "before")


def upsert_files(table: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """The table with all rows of the fresh rows' files replaced."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(fresh.select(table.columns))


def valid_vectors(rows: DataFrame, column: str, dim: int) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & (F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull()))


def delete_file(table: DataFrame, path: str, key: str = "file_path") -> DataFrame:
    return table.filter(~F.col(key).eqNullSafe(F.lit(path)))


def fetch_ids(table: DataFrame, ids: list, most: int = 100) -> DataFrame:
    """Rows of the first ``most`` distinct ids asked for; the service has that limit, too."""
    return table.filter(F.col("id").isin(list(dict.fromkeys(ids))[:most]))


def compact(spark: SparkSession, source: str, target: str, files: int) -> DataFrame:
    """Rewrite a table in ``files`` files; returns the numbers of files before and after."""
    before = spark.read.parquet(source)
    before.repartition(files).write.mode("overwrite").parquet(target)
    n = lambda p: spark.read.parquet(p).select(F.col("_metadata.file_path").alias("f")).distinct().agg(F.count(F.lit(1)).alias("n"))
    return n(source).withColumnRenamed("n", "files_before").crossJoin(n(target).withColumnRenamed("n", "files_after"))


def fresh_symbols(saved: DataFrame, listing: DataFrame) -> DataFrame:
    """Saved symbols whose file still exists unchanged (mtime in seconds, to a millionth; saved 0: not checked)."""
    now = listing.select("path", F.col("mtime").alias("now"))
    return saved.join(now, "path").filter((F.col("mtime") == 0) | (F.abs(F.col("mtime") - F.col("now")) <= 1e-6)).drop("now")


def write_audit(calls: DataFrame, path: str) -> None:
    calls.withColumn("output_preview", output_preview(F.col("output"))).select(*[c.split()[0] for c in AUDIT.split(", ")]).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def cache_embed(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses): looked up by content hash and model, so models do not evict each other."""
    keyed = texts.withColumn("content_hash", F.sha2("content", 256))
    own = cache.filter(F.col("model") == model).select("content_hash", "embedding")
    return keyed.join(own, "content_hash"), keyed.join(own, "content_hash", "left_anti")


def feature_hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: signed counts of hashed words, at unit length."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = np.array([zlib.crc32(w) for w in (t or "").lower().encode().split()], "u4")
            v = np.bincount((h >> np.uint32(1)) % np.uint32(dim), np.where(h & np.uint32(1), 1.0, -1.0), dim)
            out.append((v / (np.sqrt((v * v).sum()) or 1.0)).astype("f4"))
        return pd.Series(out)

    return F.pandas_udf(embed, "array<float>")(text)


def telemetry_batch(lines: DataFrame, schema: str) -> DataFrame:
    """Spec-derived: JSON lines (value) with the reasons of bad ones: row, bad."""
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.select(row.alias("row"), F.try_parse_json("value").isNull().alias("bad"))


def last_message(rows: DataFrame, key: str, order: str, role: str) -> DataFrame:
    return rows.filter((F.col("role") == role) & (F.trim("text") != "")).groupBy(key).agg(F.max_by("text", order).alias("text"))


def dense_number(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Batches of ``size`` rows per key, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / size))


def filter_ws_results(results: DataFrame, files: DataFrame, root: str | None) -> DataFrame:
    """Search results whose file lies in the workspace and is there, by their path relative to it; without a workspace, all."""
    if not root:
        return results
    return results.withColumn("file_path", workspace_relative(F.col("file_path"), root)).join(files.select("file_path").distinct(), "file_path", "left_semi")


def index_symbols(symbols: DataFrame, path: str | None = None) -> DataFrame:
    return symbols if path is None else symbols.filter(F.col("path") == path)


def symbol_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))


def cursor_file(contexts: DataFrame) -> DataFrame:
    """Per conversation (conv) the first implicit context's path."""
    return contexts.filter("type = 'implicit'").groupBy("conv").agg(F.min_by("file_path", "ord").alias("file_path"))
