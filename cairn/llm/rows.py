"""Rows by content: which rows of a table stay, decided on keys alone.

A row's key is 128 bits of hash of its id and text, computed from the row itself. So a decision that was made on one scan
finds its rows in any other scan, however the rows are dealt over partitions there. Rows that agree in id and text share a
key; where they are to be one, one of them stays: the least of them by a hash of all its columns.

A Bloom filter tells which rows a decision may concern. Only those meet the decision in a join; the others pass
where they lie. The filter's bits for a hash lie in one 64-bit word, so that one lookup tests them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import as_rows, field, materialize

#: Bits of a filter for each entry; a filter's least size as a power of two.
BITS_PER_ROW, MIN_LOG2 = 16, 16
#: A filter is broadcast up to 2**BROADCAST_LOG2 bits: 2**20 words, some 40 MB in an executor. The filter of decisions is
#: never larger: beyond 4 million decisions more rows than needed meet them in the join, and the result is the same.
BROADCAST_LOG2 = 26


def filter_log2(entries: int) -> int:
    return max(MIN_LOG2, (max(1, entries) * BITS_PER_ROW - 1).bit_length())


def word_of(h: Column, log2: int) -> Column:
    return h.bitwiseAND(F.lit((1 << (log2 - 6)) - 1).cast("long"))


def _positions(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, shift).cast("int").bitwiseAND(F.lit(63)) for shift in (52, 58)]


def _mask(h: Column) -> Column:
    a, b = (F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in _positions(h))
    return a.bitwiseOR(b)


def words_set(entries: DataFrame, log2: int) -> DataFrame:
    """The filter of the hashes ``h``: (word, bits)."""
    return entries.groupBy(word_of(F.col("h"), log2).alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("bits"))


def words_set_twice(entries: DataFrame, log2: int) -> DataFrame:
    """The bits that two of the hashes ``h`` or more set: (word, bits). Counts are summed before the shuffle."""
    each = entries.select(word_of(F.col("h"), log2).alias("word"), F.explode(F.array_distinct(F.array(*_positions(F.col("h"))))).alias("bit"))
    twice = each.groupBy("word", "bit").count().filter("count > 1")
    return twice.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def flagged(df: DataFrame, h: Column, words: DataFrame, log2: int) -> DataFrame:
    """``df`` with ``maybe``: whether the filter has all bits of ``h``. A filter within the bound is broadcast; with a larger one
    Spark's join deals rows by word, so ``df`` should then hold hashes, not texts."""
    side = words.select(F.col("word").alias("filter_word"), F.col("bits").alias("filter_bits"))
    side = F.broadcast(side) if log2 <= BROADCAST_LOG2 else side
    hit = F.coalesce(F.col("filter_bits").bitwiseAND(_mask(h)) == _mask(h), F.lit(False))
    return df.join(side, word_of(h, log2) == F.col("filter_word"), "left").withColumn("maybe", hit).drop("filter_word", "filter_bits")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as one column ``row``, and the row's key (k1, k2)."""
    parts = [x for c in (id_col, text_col) for x in (F.col(field(c)).isNull(), F.col(field(c)))]
    return as_rows(docs).select("row", F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))


def meeting(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (k1, k2, ...) whose key is among ``wanted`` (k1, k2, ...; written, each key once), joined with it. Of the other rows few
    take part in the join."""
    log2 = min(filter_log2(wanted.count()), BROADCAST_LOG2)
    words = materialize(words_set(wanted.select(F.col("k1").alias("h")), log2), "filter")
    return flagged(rows, F.col("k1"), words, log2).filter("maybe").drop("maybe").join(wanted, ["k1", "k2"])


def keep_first(docs: DataFrame, members: DataFrame, order: list[str], id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that are not their group's first. ``members`` has a row (g, k1, k2, and the columns
    ``order``, which depend on the key alone) for each row of ``docs`` that may share its group g; a group's first has
    the least values of ``order``, then the least key. Groups may be of any size: their rows are only counted and compared."""
    keys = members.groupBy("g", "k1", "k2", *order).agg(F.count(F.lit(1)).alias("times"))
    keys = materialize(keys, "keys")
    first = F.min(F.struct(*order, "k1", "k2")).alias("first")
    # written first: both sides of the join are then plain shuffles, and adaptive execution splits a hot group's partition
    firsts = materialize(keys.groupBy("g").agg(first, F.count(F.lit(1)).alias("n"), F.max("times").alias("most")).filter("n > 1 or most > 1").select("g", "first"), "firsts")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    decided = keys.join(firsts, "g").select("k1", "k2", stays.alias("stays"), "times").filter("not stays or times > 1")
    decided = materialize(decided.select("k1", "k2", "stays"), "decided")
    n, again = decided.agg(F.count(F.lit(1)), F.count_if("stays")).first()
    if not n:
        return docs
    log2 = min(filter_log2(n), BROADCAST_LOG2)
    words = materialize(words_set(decided.select(F.col("k1").alias("h")), log2), "filter")
    rows = flagged(keyed(docs, id_col, text_col), F.col("k1"), words, log2)
    met = rows.filter("maybe").join(decided, ["k1", "k2"], "left")
    kept = rows.filter("not maybe").select("row").union(met.filter("stays is null").select("row"))
    if again:  # rows that agree in id and text, whose key stays: one of each
        one = met.filter("stays").groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.union(one.select("row"))
    return kept.select("row.*")
