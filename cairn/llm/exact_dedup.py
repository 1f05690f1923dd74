"""Exact dedup: a two-pass Bloom filter finds possibly repeated texts; only those rows shuffle.

Everything is DataFrame functions. Pass one counts, per bit of the filter, how many rows set it; a row whose
text occurs twice finds all of its bits set at least twice. Pass two tests every row's hash against the bits that were
set twice: rows that fail are certainly alone and pass straight through, the others shuffle by SHA-256 of the
normalised text, which decides exactly. The filter grows with the table: while it is small enough it is broadcast, beyond
that hashes (never texts) are dealt by its words. Texts are moved by ``keep_first`` alone, and only where a key matches.

Defined results: null text is empty, and all empty texts are equal. Of equal texts the longest original (code
points), then the smallest doc_id (null last) stays, then in exact_groups the first row read, in drop_exact_copies the least
key of id and text. Rows that repeat a doc_id are rows of their own; one of them stays. An empty table gives an empty
result. Other columns are not looked at, whatever their names. ``docs`` may be any plan whose rows do not change
from one evaluation to the next; their order and partitions may.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACES, as_rows, field, materialize, table, text_of
from cairn.llm.rows import filter_log2, flagged, keep_first, keyed, words_set_twice


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c)), SPACES, text)


def _possible(lite: DataFrame) -> DataFrame:
    """``lite`` (written; with column sha) and ``maybe``: whether the text may occur twice."""
    log2 = filter_log2(lite.count())
    words = materialize(words_set_twice(lite.select(F.xxhash64("sha").alias("h")), log2), "filter")
    return flagged(lite, F.xxhash64("sha"), words, log2)


def _marks(text_col: str) -> list[Column]:
    text = text_of(field(text_col))
    return [F.length(text).cast("long").alias("n"), F.sha2(normalised(text).cast("binary"), 256).alias("sha")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    # the row number is written with the row, and every later step reads what was written
    lite = materialize(as_rows(docs).select(F.col(field(id_col)).alias("doc_id"), F.monotonically_increasing_id().alias("at"), *_marks(text_col)), "exact")
    rows = _possible(lite)
    maybe, alone = rows.filter("maybe"), rows.filter("not maybe")
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("at").alias("at"))
    # written first: both sides of the join are then plain shuffles, and adaptive execution splits a hot group's partition
    groups = materialize(maybe.groupBy(F.col("sha").alias("group")).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    together = maybe.join(groups, F.col("sha") == F.col("group")).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    ).unionByName(together)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Rows that the filters clear pass without a shuffle."""
    own = F.col(field(id_col))
    lite = materialize(keyed(docs, id_col, text_col).select("k1", "k2", own.alias("id"), *_marks(text_col)), "exact")
    maybe = _possible(lite).filter("maybe")
    members = maybe.select(F.col("sha").alias("g"), "k1", "k2", (-F.col("n")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id")
    return keep_first(docs, members, ["shorter", "no_id", "id"], id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER w AS k
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g
"""
