"""Exact quantiles by ranges, and day bits, against plain computations."""

import datetime
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import metrics, search


def test_exact_quantiles(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.5, round(rnd.gauss(0, 9), 3), None])) for _ in range(900)] + [("one", 4.0), ("null", None)] + [("same", 7.0)] * 300
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    qs = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    got = {r.g: [r[q] for q in qs] for r in search.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", qs).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert np.allclose(got[g], np.quantile(own, list(qs.values())))
    report = search.latency_report(spark.createDataFrame(rows, "g string, v double"), "v", F.col("g") == "a").first()
    every = [v for _, v in rows if v is not None]
    assert np.allclose([report.p50, report.p95, report.mean, report.max], [np.quantile(every, 0.5), np.quantile(every, 0.95), np.mean(every), max(every)])
    empty = search.latency_report(spark.createDataFrame([], "g string, v double"), "v", F.lit(True)).first()
    assert (empty.p50, empty.mean, empty.errors) == (None, None, 0)


def test_increments_equal_a_rebuild(spark):
    rnd, start = random.Random(4), datetime.datetime(2023, 12, 20)
    rows = [(rnd.randrange(40), start + datetime.timedelta(days=rnd.choice([0, 1, 7, 8, 30, 31, rnd.randrange(90)]), hours=rnd.randrange(24))) for _ in range(600)] + [(None, start), (3, None)]
    frame = spark.createDataFrame([(u, t, k % 3) for k, (u, t) in enumerate(rows)], "user_id long, ts timestamp, batch int")
    whole = metrics.retention(metrics.day_bits(frame, "user_id", "ts"))
    parts = metrics.merge_bits(*[metrics.day_bits(frame.filter(F.col("batch") == k), "user_id", "ts") for k in range(3)])
    days = defaultdict(set)
    for u, t in rows:
        if u is not None and t is not None:
            days[u].add(t.date())
    want = defaultdict(lambda: [0, 0, 0, 0])
    for own in days.values():
        first = min(own)
        counts = want[first]
        counts[0] += 1
        for k, d in enumerate((1, 7, 30), 1):
            counts[k] += first + datetime.timedelta(days=d) in own
    for got in (whole, metrics.retention(parts)):
        assert {r.cohort: [r.users, r.d1, r.d7, r.d30] for r in got.collect()} == dict(want)
