"""Usage metrics. Those marked spec-derived have a description to follow, but no code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adoption_rate(events: DataFrame, by: str, shown: str, taken: str) -> DataFrame:
    """Spec-derived: accepted of generated, per key."""
    n = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    return events.groupBy(by).agg(n(shown).alias("shown"), n(taken).alias("taken")).withColumn("rate", F.round(F.col("taken") / F.nullif(F.col("shown"), F.lit(0)), 6))


def daily_actives(events: DataFrame, user: str, ts: str) -> DataFrame:
    """Spec-derived."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.countDistinct(user).alias("dau"))


def day_bits(events: DataFrame, user: str, ts: str) -> DataFrame:
    """(user, word, bits): the days on which a user was seen, a bit each, 32 to a word. Rows of several batches merge by ``merge_bits``."""
    day = F.unix_date(F.to_date(ts))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(32)))
    return events.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(user).alias("user"), F.floor(day / 32).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_bits(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("user", "word").agg(F.bit_or("bits").alias("bits"))


def retention(bits: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Spec-derived: of the users first seen on a day, how many come back n days later, from ``day_bits``. A user's rows are as many as months of use."""
    lowest = F.log2(F.col("bits").bitwiseAND(-F.col("bits")).cast("double")).cast("int")
    users = bits.groupBy("user").agg(F.min(F.col("word") * 32 + lowest).alias("first"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("seen"))

    def back(d: int) -> Column:
        day = F.col("first") + d
        word = F.coalesce(F.try_element_at("seen", F.floor(day / 32).cast("int")), F.lit(0).cast("long"))
        return F.count_if(F.call_function("getbit", word, F.pmod(day, F.lit(32))) == 1).alias(f"d{d}")

    return users.groupBy(F.date_from_unix_date("first").alias("cohort")).agg(F.count(F.lit(1)).alias("users"), *map(back, days))


def pass_at_k(samples: DataFrame, problem: str, ordinal: str, passed: Column, k: int) -> DataFrame:
    """Spec-derived: share of problems of whose first k samples one passes."""
    best = samples.filter(F.col(ordinal) < k).groupBy(problem).agg(F.bool_or(passed).cast("double").alias("p"))
    return best.agg(F.round(F.avg("p"), 6).alias("pass_at_k"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Spec-derived: Cohen's kappa of two binary markings."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select(F.round((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def fim_split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spec-derived: prefix, hole of 20 to 50 % and suffix, and one of three orders, by the id's hash."""
    h = lambda k: F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{k}"))), 1, 8), 16, 10).cast("long")
    n = F.length(text_col)
    hole = F.floor(n * (20 + h(0) % 31) / 100)
    start = F.floor((n - hole) * (h(1) % 101) / 100)
    return docs.select(id_col, F.element_at(F.array(F.lit("PSM"), F.lit("SPM"), F.lit("PMS")), (h(2) % 3 + 1).cast("int")).alias("form"), start.alias("prefix_chars"), hole.alias("hole_chars"), (n - start - hole).alias("suffix_chars"))


def avg_rounds(messages: DataFrame, key: str) -> DataFrame:
    """Spec-derived: mean number of user messages per task."""
    rounds = messages.groupBy(key).agg(F.sum((F.col("role") == "user").cast("long")).alias("rounds"))
    return rounds.agg(F.round(F.avg("rounds"), 6).alias("avg_rounds"), F.count(F.lit(1)).alias("tasks"))


def leaderboard(samples: DataFrame, model: str, problem: str, passed: Column) -> DataFrame:
    """Spec-derived: models by the share of problems that one of their samples passes; equal shares share a rank."""
    best = samples.groupBy(model, problem).agg(F.bool_or(passed).cast("double").alias("p"))
    board = best.groupBy(model).agg(F.round(F.avg("p"), 6).alias("pass_rate"), F.count(F.lit(1)).alias("problems"))
    # models are counted by rate first, so that what is ordered is one row per rate
    rates = board.groupBy("pass_rate").agg(F.count(F.lit(1)).alias("models"))
    above = F.coalesce(F.sum("models").over(W.orderBy(F.desc("pass_rate")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    return board.join(rates.select("pass_rate", above.cast("int").alias("place")), "pass_rate").select(model, "pass_rate", "problems", "place")


def windowed_counts(events: DataFrame, ts: str, window: str) -> DataFrame:
    """Spec-derived: event counts by tumbling window and type; the stream's batch form."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
