"""Sessions with an end, on a stream that stops and goes on from its checkpoint, against one run over all events."""

import datetime

from cairn.streaming import jobs

DAY = datetime.datetime(2024, 1, 1)


def test_sessions_end_by_time(spark, tmp_path):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    batches = [
        [("a", at(0), 1, "append", "hi"), ("a", at(5), 2, "append", "hi"), ("a", at(50), 3, "read", None), ("b", at(0), 4, "read", None), ("b", at(1), 5, "append", "x")],
        [("a", at(100), 6, "append", "more"), ("c", at(100), 7, "append", "y"), ("c", at(101), 8, "delete", None), ("c", at(102), 9, "read", None)],
        [("a", at(155), 10, "read", None), ("d", at(400), 11, "append", "z")],  # the watermark passes the ends of a and b
        [("a", at(405), 12, "read", None), ("d", at(600), 13, "append", "late")],
    ]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    try:
        got = []
        for batch in batches:
            spark.createDataFrame(batch, jobs.SESSION_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            stream = jobs.session_store_stream(spark.readStream.schema(jobs.SESSION_EVENTS).parquet(str(tmp_path / "events")), 60, "10 seconds")
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            run.awaitTermination()  # each round goes on from the checkpoint of the one before
        got = {(r.session, (r.at_ms // 1000) - int(DAY.replace(tzinfo=datetime.timezone.utc).timestamp()), r.kind, r.messages) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = {("a", 50, "read", 1), ("b", 0, "read", -1), ("c", 102, "read", -1), ("a", 155, "read", 2), ("b", 61, "expired", 1), ("a", 215, "expired", 2), ("a", 405, "read", -1), ("d", 460, "expired", 1)}
    assert got == want
