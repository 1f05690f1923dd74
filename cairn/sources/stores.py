"""Written stores: symbols, graphs, postings, logs, markers, training files and telemetry. Every store is a folder of
Parquet or JSON lines, so executors write their own part and any of them can be lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.scratch import file_system, scratch  # noqa: F401 - scratch is part of this module's surface
from cairn.sources.tables import compact, fresh_symbols, valid_vectors


def vec_insert(path: str, rows: DataFrame, column: str, dim: int) -> None:
    """Append the rows whose vector has ``dim`` numbers and no null."""
    valid_vectors(rows, column, dim).write.mode("append").parquet(path)


def vec_clear(path: str, spark: SparkSession) -> None:
    """Delete all rows; the schema stays."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def drop_store(spark: SparkSession, path: str) -> bool:
    """Delete the whole table; false where there is none."""
    fs, where = file_system(spark, path)
    return fs.delete(where, True)


def vec_compact(spark: SparkSession, source: str, target: str, files: int) -> DataFrame:
    return compact(spark, source, target, files)


def save_symbols(symbols: DataFrame, path: str) -> None:
    """Symbols with their file's mtime."""
    symbols.write.mode("overwrite").parquet(path)


def load_symbols(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """Saved symbols of files that are still there, unchanged."""
    return fresh_symbols(spark.read.parquet(path), listing)


def save_graph(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forward, reverse) edges; the reverse ones are derived."""
    e = spark.read.parquet(path)
    return e, e.select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type")


def write_planner_log(calls: DataFrame, path: str) -> None:
    """One JSON row per planner call (goal, model, attempt, success, raw)."""
    calls.write.mode("append").json(path)


def write_marker(rows: DataFrame, path: str, workspace: str) -> None:
    """A marker that an index is complete: one row of counts, written after the index."""
    rows.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files")).select(F.lit(workspace).alias("workspace"), "files", "chunks", F.lit("completed").alias("status")).write.mode("overwrite").json(path)


def write_sft(messages: DataFrame, path: str, key: str, order: str) -> None:
    """Spec-derived: a conversation per JSON line, its messages in order. A conversation is one example, so it fits a row."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", F.coalesce("text", F.lit("")).alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    messages.groupBy(key).agg(listed.alias("messages")).write.mode("overwrite").json(path)


def read_sft(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(f"{key} long, messages array<struct<role:string,content:string>>").json(path)


def write_cues(pairs: DataFrame, path: str) -> None:
    """Spec-derived: click and edit pairs as Parquet."""
    pairs.write.mode("overwrite").parquet(path)


def click_then_edit(clicks: DataFrame, edits: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    """Spec-derived: each click (key, click_id, at) with the edits (key, edit_id, at) that follow within ``seconds``. Both sides are
    keyed by time bins of that length too, so a hot key's rows spread over many tasks."""
    width = F.lit(seconds)
    a = clicks.withColumn("bin", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)))
    b = edits.withColumnRenamed("at", "edit_at").withColumn("bin", F.floor(F.col("edit_at") / width))
    return a.join(b, [key, "bin"]).filter((F.col("edit_at") > F.col("at")) & (F.col("edit_at") <= F.col("at") + width)).drop("bin")


def read_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Spec-derived: JSON lines, gzip or plain; a row that does not fit the schema is in ``_bad``."""
    row = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(row.alias("r")).select("r.*")
