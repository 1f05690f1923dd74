"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMITED = "user_id long, t double, accepted boolean"
LIMIT_STATE = "minute array<double>, day array<double>"


def rate_limit_stream(requests: DataFrame, per_minute: int = 20, per_day: int = 500, forget_after: int | None = None) -> DataFrame:
    """(user_id, t, accepted) of a stream (user_id, t in seconds). State holds the accepted times of the last minute and
    day, so it is bounded by the limits. A stream that runs for ever should give ``forget_after``, in seconds of processing
    time, a day or more: a user who is not heard of for so long is forgotten. (A stream that ends when its input does
    must not: with such a timeout it waits for ever.)"""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        minute, day = map(list, state.get) if state.exists else ([], [])
        out = []
        for t in sorted(t for b in batches for t in b["t"]):
            minute, day = [x for x in minute if x > t - 60], [x for x in day if x > t - 86400]
            fits = len(minute) < per_minute
            ok = fits and len(day) < per_day
            if fits:
                minute.append(t)
            if ok:
                day.append(t)
            out.append((key[0], t, ok))
        state.update((minute, day))
        if forget_after is not None:
            state.setTimeoutDuration(forget_after * 1000)
        yield pd.DataFrame(out, columns=["user_id", "t", "accepted"])

    return requests.groupBy("user_id").applyInPandasWithState(decide, LIMITED, LIMIT_STATE, "append", GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout)


def session_ttl_stream(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream (user_id, ts timestamp) that end after ``idle`` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def telemetry_metrics(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spec-derived: event counts by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def latest_changes(changes: DataFrame) -> DataFrame:
    """Of file changes (path, seq, action, content) the last one per path."""
    return changes.withColumn("__rn", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).filter("__rn = 1").drop("__rn")


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The file table (path, content) after a batch of changes: changed paths leave, those not deleted come back."""
    last = latest_changes(changes)
    return table.join(last.select("path"), "path", "left_anti").select("path", "content").unionByName(last.filter("action <> 'delete'").select("path", "content"))


INDEX = "path string, content string, deleted boolean"


def incremental_index(changes: DataFrame, table_path: str, checkpoint: str):
    """Keeps an index of files up to date: each batch writes the last change of each of its paths to ``table_path``/v=N, and nothing
    else. A repeated batch writes the same again."""

    def batch(df: DataFrame, number: int) -> None:
        last = latest_changes(df).select("path", "content", (F.col("action") == "delete").alias("deleted"))
        last.write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, table_path: str) -> DataFrame:
    """(path, content) of the files that are there: each path's newest row, unless it says that the file was deleted."""
    log = spark.read.schema(f"{INDEX}, v long").parquet(table_path)
    newest = log.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "v").alias("r"))
    return newest.filter("not r.deleted").select("path", "r.content")


def compact_index(spark: SparkSession, source: str, target: str) -> None:
    """The index without its history, as version -1 of a new folder."""
    read_index(spark, source).withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{target}/v=-1")


def click_then_edit_stream(clicks: DataFrame, edits: DataFrame, key: str, seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """Spec-derived: of two streams (key, click_id, at timestamp) and (key, edit_id, at timestamp), each click with the edits that
    follow within ``seconds``. Watermarks and the interval bound what both sides keep."""
    a = clicks.select(F.col(key).alias("clicked"), "click_id", F.col("at").alias("click_at")).withWatermark("click_at", late)
    b = edits.select(F.col(key).alias("edited"), "edit_id", F.col("at").alias("edit_at")).withWatermark("edit_at", late)
    soon = (F.col("edit_at") > F.col("click_at")) & (F.col("edit_at") <= F.col("click_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return a.join(b, (F.col("clicked") == F.col("edited")) & soon).select(F.col("clicked").alias(key), "click_id", "edit_id", "click_at", "edit_at")


#: The state store that ``session_store_stream`` needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Messages of a session that its state keeps.
SESSION_MESSAGES = 200
SESSION_EVENTS = "session string, at timestamp, ord long, op string, message string"


class SessionStore(StatefulProcessor):
    """State of a session: its last SESSION_MESSAGES messages and when it ends. Appending and reading put the end off; a timer in event time ends it."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "messages array<string>, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        held, out = None, []
        if self.state.exists():
            messages, ends = self.state.get()
            held = (list(messages), ends)
        batch = pd.concat(list(rows)).sort_values(["at", "ord"], kind="stable")
        for at, op, message in zip((batch["at"].astype("datetime64[ms]").astype("int64")).tolist(), batch["op"], batch["message"], strict=True):
            if held and held[1] <= at:
                out.append((held[1], "expired", len(held[0])))
                held = None
            if op == "delete":
                held = None
            elif op == "append":
                messages = held[0] if held else []
                if not messages or messages[-1] != message:  # a message sent again is one
                    messages = [*messages, message][-SESSION_MESSAGES:]
                held = (messages, at + self.ttl)
            elif op == "read":
                out.append((at, "read", len(held[0]) if held else -1))
                held = (held[0], at + self.ttl) if held else None
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held:
            self.state.update((held[0], held[1]))
            self.handle.registerTimer(held[1])
        else:
            self.state.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.state.exists():
            messages, ends = self.state.get()
            out.append((ends, "expired", len(messages)))
            self.state.clear()
        yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        numbers = lambda values: pd.Series(values, dtype="int64")
        return pd.DataFrame({"session": text([key[0]] * len(out)), "at_ms": numbers([a for a, *_ in out]), "kind": text([k for _, k, _ in out]), "messages": numbers([n for *_, n in out])})

    def close(self) -> None:
        pass


def session_store_stream(events: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(session, at_ms, kind, messages) from a stream of SESSION_EVENTS (op append, read or delete): each read with the number of messages that it finds (-1: no
    session), and each end by time. A session lives ``ttl_seconds`` from its last append or read; what comes later than the watermark allows is dropped,
    and a session that nothing more is heard of ends when the watermark passes its end. Needs ``spark.sql.streaming.stateStore.providerClass`` to be ROCKS."""
    return events.withWatermark("at", late).groupBy("session").transformWithStateInPandas(SessionStore(ttl_seconds * 1000), "session string, at_ms long, kind string, messages long", "Append", "EventTime")
