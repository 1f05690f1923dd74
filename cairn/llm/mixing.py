"""Mixing sources to target weights: tokens per source, repetition rates, then floor(rate) copies of each
document plus one hash-seeded Bernoulli copy with probability equal to the fraction.

The Bernoulli draws of a document come from its id alone, one draw for each of ``SEEDS`` seeds; each source uses
the seed whose total comes nearest to its target (ties: the smaller seed), which one pass over ids and sizes finds.
So reruns agree and each source's words come near its target even where a few long documents hold most of them.

Defined results: null text has size 0; null sources form one source, last in order; a null id draws as the empty
text; rows that repeat an id draw alike and are kept apart; a source without words has target 0; an empty table gives
an empty result. No rate is above ``MAX_RATE``, so no document is repeated more often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import WORD, as_rows, field, materialize, quoted, table, text_of

WEIGHTS, MAX_RATE, SEEDS = (5, 2, 1), 3, 32


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draws(id_col: str) -> list[Column]:
    """SEEDS numbers in [0, 1) for an id: eight hex digits each of SHA-256 of the id and a round number."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return [
        F.conv(F.substring(F.sha2(F.concat(text, F.lit(f":{k // 8}")), 256), 8 * (k % 8) + 1, 8), 16, 10).cast("double") / 4294967296.0
        for k in range(SEEDS)
    ]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Per source (__source, __total): target, by filling sources in the order of cap / weight.

    Sharing the excess by weight until no target is above its cap gives min(cap, level * weight) with one level
    for all; with sources in the order of cap / weight, the capped ones are a prefix, so running sums find it.
    The windows have no partition: they see one row per source, not per document.
    """
    order = W.orderBy(F.col("__source").isNull(), F.col("__source").cast("binary"))
    fill = W.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    ranked = (
        sizes.withColumn("__rank", F.row_number().over(order))
        .withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("__cap", max_rate * F.col("__total"))
        .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__weight"))
    )
    filled = (
        ranked.withColumn("__rest", F.sum("__total").over(whole) - F.sum("__cap").over(fill) + F.col("__cap"))
        .withColumn("__open", F.sum("__weight").over(whole) - F.sum("__weight").over(fill) + F.col("__weight"))
        .withColumn("__level", F.col("__rest").cast("double") / F.col("__open"))
    )
    # a source is capped while its cap / weight is no more than the level left when it is reached
    level = F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__rank", "__level"))).over(whole)
    return filled.select(
        "__source", "__total",
        F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__weight") * level.getField("__level"), F.col("__cap").cast("double"))).alias("target"),
    )


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("__source"), size_of(text_of(quoted(text_col))).alias("size")), "mix")


def _source_rates(lite: DataFrame) -> DataFrame:
    """Per source (__key): __total, target, __rate, __frac and __seed; written, so that joins know its size."""
    targets = source_targets(lite.groupBy("__source").agg(F.sum("size").alias("__total")))
    rates = targets.withColumn("__rate", F.when(F.col("__total") > 0, F.col("target") / F.col("__total")).otherwise(0.0))
    rates = materialize(rates.withColumn("__frac", F.col("__rate") - F.floor("__rate")).withColumnRenamed("__source", "__key"), "rates")
    extra = [F.sum(F.when(u < F.col("__frac"), F.col("size")).otherwise(0)).alias(f"__s{k}") for k, u in enumerate(draws("doc_id"))]
    miss = [F.struct(F.abs(F.col(f"__s{k}") - F.col("__frac") * F.col("__total")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    drawn = lite.join(rates, F.col("__source").eqNullSafe(F.col("__key"))).groupBy("__key", "__frac", "__total").agg(*extra)
    seeds = drawn.select(F.col("__key").alias("__key2"), F.least(*miss).getField("seed").alias("__seed"))
    return materialize(rates.join(seeds, F.col("__key").eqNullSafe(F.col("__key2"))).drop("__key2"), "seeds")


def _copies(id_col: str) -> Column:
    """How often a document is taken: its source's whole rate, and one more by its own draw."""
    draw = F.element_at(F.array(*draws(id_col)), F.col("__seed") + 1)
    return (F.floor("__rate") + F.when(draw < F.col("__frac"), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    lite = _sizes(docs, id_col, text_col, source_col)
    planned = lite.join(_source_rates(lite), F.col("__source").eqNullSafe(F.col("__key"))).withColumn("copies", _copies("doc_id"))
    return planned.select("doc_id", "size", F.col("__total").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as the mix takes it, with its own columns. A document's copies follow from its id
    and its source's row, so texts are not shuffled while the sources' table is small enough for Spark to broadcast."""
    rates = _source_rates(_sizes(docs, id_col, text_col, source_col)).select("__key", "__rate", "__frac", "__seed")
    own = as_rows(docs).join(rates, F.col(field(source_col)).eqNullSafe(F.col("__key"))).withColumn("copies", _copies(field(id_col))).filter("copies > 0")
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def _draw_sql(k: int) -> str:
    return f"(('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '') || ':{k // 8}'), {8 * (k % 8) + 1}, 8))::BIGINT / 4294967296.0::DOUBLE)"


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
           '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'), '\n', '', 'g'))::BIGINT AS size,
         {", ".join(f"{_draw_sql(k)} AS u{k}" for k in range(SEEDS))}
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * total AS cap FROM r),
o AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
f AS (SELECT *, ((sum(total) OVER ()) - (sum(cap) OVER q) + cap)::DOUBLE / ((sum(weight) OVER ()) - (sum(weight) OVER q) + weight)::DOUBLE AS level
      FROM o WINDOW q AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
l AS (SELECT first(level ORDER BY ratio, rank) AS level FROM f WHERE ratio > level),
t AS (SELECT f.source, f.total, least(f.cap::DOUBLE, coalesce(f.weight * l.level, f.cap::DOUBLE)) AS target FROM f LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate FROM t),
g AS (SELECT *, rate - floor(rate) AS frac FROM e),
x AS (SELECT d.*, g.total, g.target, g.rate, g.frac FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
m AS (SELECT source, [{", ".join(f"abs(sum(CASE WHEN u{k} < frac THEN size ELSE 0 END)::DOUBLE - any_value(frac) * any_value(total))" for k in range(SEEDS))}] AS miss
      FROM x GROUP BY source),
k AS (SELECT source, list_position(miss, list_min(miss)) AS seed FROM m),
y AS (SELECT x.*, (floor(rate) + CASE WHEN [{", ".join(f"u{k}" for k in range(SEEDS))}][k.seed] < frac THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM x JOIN k ON x.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, total AS source_size, target, copies, size * copies AS taken FROM y
"""
