"""Sessions, quotas and limits as windows and folds."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X


def msg_dedupe(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Without messages that repeat role and text of the one before."""
    w = W.partitionBy(key).orderBy(order)
    same = F.lag("role").over(w).eqNullSafe(F.col("role")) & F.lag("text").over(w).eqNullSafe(F.col("text")) & F.lag(F.lit(1)).over(w).isNotNull()
    return messages.withColumn("__same", same).filter("not __same").drop("__same")


def session_trim(messages: DataFrame, key: str, order: str, rounds: int = 10, budget: int = 8000, margin: float = 0.1, reserved: int = 0) -> DataFrame:
    """System messages, and the newest others: 2 * rounds at most, while the tokens of all fit."""
    limit = max(0, int(budget * (1 - margin)) - reserved)
    w = W.partitionBy(key, F.col("role") == "system").orderBy(F.desc(order))
    n = F.length(F.coalesce("text", F.lit("")))
    system = F.sum(F.when(F.col("role") == "system", n).otherwise(0)).over(W.partitionBy(key))
    run = messages.withColumn("__rn", F.row_number().over(w)).withColumn("__cum", F.sum(n).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("__sys", system)
    keep = (F.col("role") == "system") | ((F.col("__rn") <= 2 * rounds) & (F.floor((F.col("__sys") + F.col("__cum")) / 4) <= limit))
    return run.filter(keep).drop("__rn", "__cum", "__sys")


def quota_usage(usage: DataFrame, user: str, ts: str, tokens: str, limit: int) -> DataFrame:
    day = F.to_date(ts)
    used = usage.filter(F.col(tokens) > 0).groupBy(X.hash_user(F.col(user)).alias("user_hash"), day.alias("day")).agg(F.sum(tokens).alias("used"))
    return used.withColumn("percentage", F.round(F.least(F.col("used") / limit, F.lit(1.0)), 4)).withColumn("reset_at", F.date_add("day", 1))


def consecutive_failures(log: DataFrame, key: str, order: list[str], failed: Column, most: int = 3) -> DataFrame:
    """Each row's streak of failures; a success starts anew (gaps and islands)."""
    w = W.partitionBy(key).orderBy(*order)
    run = log.withColumn("__f", failed).withColumn("__g", F.sum((~F.col("__f")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    streak = F.sum(F.col("__f").cast("int")).over(W.partitionBy(key, "__g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return run.withColumn("streak", streak).withColumn("fused", F.col("streak") >= most).drop("__f", "__g")


def same_diff_fuse(attempts: DataFrame, key: str, order: str, diff: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return attempts.withColumn("fused", F.coalesce((F.col(diff) != "") & (F.lag(diff).over(w) == F.col(diff)), F.lit(False)))


def diff_error_fuse(attempts: DataFrame, key: str, order: str, error: str, n: int = 3) -> DataFrame:
    last = F.collect_list(F.coalesce(error, F.lit(""))).over(W.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0))
    return attempts.withColumn("__l", last).withColumn("fused", (F.size("__l") == n) & (F.size(F.array_distinct("__l")) == n) & ~F.array_contains("__l", "")).drop("__l")


def repair_budget(attempts: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(key).orderBy(order))
    return attempts.withColumn("allowed", rn <= most)


def rate_limit(requests: DataFrame, user: str, seconds: str, per_minute: int = 20, per_day: int = 500) -> DataFrame:
    """(user, n-th request, t, accepted): sliding windows in which only accepted requests count. The minute slot is
    taken even where the day then rejects. Requests stream by in the order of user and time; only what the windows hold is
    kept, so a user of any number of requests needs no more memory than the limits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, minute, day = None, 0, deque(), deque()
        for b in batches:
            numbers, accepted = [], []
            for who, t in zip(b["who"], b["t"], strict=True):
                if who != now:
                    now, n, minute, day = who, 0, deque(), deque()
                while minute and minute[0] <= t - 60:
                    minute.popleft()
                while day and day[0] <= t - 86400:
                    day.popleft()
                fits = len(minute) < per_minute
                ok = fits and len(day) < per_day
                minute.extend([t] * fits)
                day.extend([t] * ok)
                numbers.append(n)
                accepted.append(ok)
                n += 1
            yield b.assign(n=numbers, accepted=accepted)

    kind = dict(requests.dtypes)[user]
    own = requests.select(F.col(user).cast("string").alias("who"), F.col(seconds).cast("double").alias("t"))
    done = own.repartition("who").sortWithinPartitions("who", "t").mapInPandas(run, "who string, t double, n int, accepted boolean")
    return done.select(F.col("who").cast(kind).alias(user), "n", "t", "accepted")


def rate_reset(oldest: Column, now: Column, window: int = 60) -> Column:
    return F.ceil(oldest + window - now)


def session_ttl(events: DataFrame, key: str, ts: str, idle: str = "1 hour") -> DataFrame:
    """Sessions that end after ``idle`` without an event."""
    w = F.session_window(F.col(ts).cast("timestamp"), idle)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("expires"), "n")


def latest_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows per key: bounded queues and key-value stores as tables."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__rn") <= n).drop("__rn")


def react_context(steps: DataFrame, key: str, order: str, n: int = 3, chars: int = 500) -> DataFrame:
    """Finished steps; of each key the last ``n`` keep their observation, cut to ``chars`` characters. Texts are cut before rows are
    ordered, so that whole ones are not moved."""
    text = F.when(F.length("observation") > chars, F.concat(F.left("observation", F.lit(chars)), F.lit("..."))).otherwise(F.col("observation"))
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return steps.filter("status = 'done'").withColumn("observation", text).withColumn("__rn", rn).withColumn("observation", F.when(F.col("__rn") <= n, F.col("observation"))).drop("__rn")


def confirm_check(issued: DataFrame, confirmed: DataFrame, ttl: int = 300) -> DataFrame:
    """First confirmation of each token in its session within ``ttl`` seconds; a token is good once."""
    first = confirmed.groupBy("token", "session").agg(F.min("at").alias("at"), F.min_by("allow", "at").alias("allow"))
    return issued.join(first, ["token", "session"]).filter(F.col("at").between(F.col("issued_at"), F.col("issued_at") + ttl)).select("token", "session", "allow")


def confirm_store(issued: DataFrame, lookups: DataFrame, ttl: int = 300) -> DataFrame:
    """Lookups (token, ord, at, kind get or pop) of tokens (token, issued_at) with found. A get finds a token up to ``ttl``
    seconds old and removes an older one; a pop finds any token that is still there, whatever its age, and removes it."""
    j = lookups.join(issued, "token", "left").withColumn("__late", F.col("at") - F.col("issued_at") > ttl)
    removes = (F.col("kind") == "pop") | F.col("__late")
    gone = F.coalesce(F.max(removes.cast("int")).over(W.partitionBy("token").orderBy("at", "ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    return j.withColumn("found", F.coalesce(~gone & ((F.col("kind") == "pop") | ~F.col("__late")), F.lit(False))).drop("__late")


def session_store(writes: DataFrame, lookups: DataFrame, key: str, at: str, ttl: int = 86400) -> DataFrame:
    """``lookups`` (key, at, ...) with ``value``: the latest write (key, at, value) before, if it is at most ``ttl`` seconds old; a lookup
    that finds a session keeps it alive for as long again. One sort by key and time; a lookup's own age counts from the last
    write or successful lookup, so gaps of more than ``ttl`` cut a session."""
    w = W.partitionBy(key).orderBy(at, "is_lookup")
    rest = [c for c in lookups.columns if c not in (key, at)]
    row = lambda df, look, value: df.select(key, F.col(at).alias(at), F.lit(look).alias("is_lookup"), value.alias("value"), *[(F.col(c) if look else F.lit(None)).alias(c) for c in rest])
    both = row(writes, False, F.struct(F.col("value"))).unionByName(row(lookups, True, F.lit(None)))
    gap = F.coalesce(F.col(at) - F.lag(at).over(w) > ttl, F.lit(True))
    cut = both.withColumn("life", F.sum((gap | ~F.col("is_lookup")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = F.last("value", ignorenulls=True).over(W.partitionBy(key, "life").orderBy(at, "is_lookup").rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("value", last.getField("value")).filter("is_lookup").select(*lookups.columns, "value")


def _cached(requests: DataFrame, ttl: int) -> DataFrame:
    """Requests (key, at) with hit, without a limit on entries: rows stream by in the order of key and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since = None, 0.0
        for b in batches:
            hits = []
            for k, at in zip(b["key"], b["at"], strict=True):
                hit = k == key and at - since <= ttl
                if not hit:
                    key, since = k, at
                hits.append(hit)
            yield b.assign(hit=hits)

    own = requests.select("key", F.col("at").cast("double").alias("at"))
    return own.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, "key string, at double, hit boolean")


def retrieval_cache(requests: DataFrame, ttl: int = 300, entries: int | None = None, place: str | None = None) -> DataFrame:
    """Requests (key, at in seconds) with hit: served from the result computed at most ``ttl`` seconds before. The index's
    version belongs in the key, so a change of the index empties the cache. With ``entries``, each cache (of a process: column
    ``place``) holds that many results and gives up the one used least recently; its requests stream by in the order of time
    and only the entries held are kept. Without, only the last computation of a key is kept, so a hot key needs no memory."""
    if entries is None:
        return _cached(requests, ttl)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, OrderedDict()
        for b in batches:
            hits = []
            for where, k, at in zip(b["place"], b["key"], b["at"], strict=True):
                if where != now:
                    now, held = where, OrderedDict()
                hit = k in held and at - held[k] <= ttl
                if not hit:
                    held[k] = at
                held.move_to_end(k)
                if len(held) > entries:
                    held.popitem(last=False)
                hits.append(hit)
            yield b.assign(hit=hits)

    own = requests.select((F.col(place).cast("string") if place else F.lit("")).alias("place"), "key", F.col("at").cast("double").alias("at"))
    return own.repartition("place").sortWithinPartitions("place", "at", "key").mapInPandas(run, "place string, key string, at double, hit boolean")


def rate_cleanup(log: DataFrame, seconds: str, now: float, window: int = 86400) -> DataFrame:
    """Requests that a limit may still count."""
    return log.filter(F.col(seconds) > now - window)


def quota_cleanup(usage: DataFrame, day: str, today: Column, keep: int = 1) -> DataFrame:
    """Usage rows of the last ``keep`` days."""
    return usage.filter(F.col(day) > F.date_sub(today, keep))


def token_usage_record(requests: DataFrame, key: str) -> DataFrame:
    """Input and output tokens per request: an answer's tokens and those of everything before it in its conversation."""
    n = F.length(F.coalesce("text", F.lit("")))
    before = F.coalesce(F.sum(n).over(W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return requests.withColumn("input_tokens", X.estimate_tokens(before)).withColumn("output_tokens", X.estimate_tokens(n)).filter("role = 'assistant'").withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
