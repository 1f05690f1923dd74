"""Hard negatives against a search over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score double, ids string, block int"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    live = {}
    for i, label, v in sorted(((r[0], r[1], r[2]) for r in rows if None not in r[:3] and None not in r[2] and all(map(math.isfinite, r[2]))), key=lambda r: (r[0], r[1], r[2])):
        live.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in filter(is_anchor, live):
        label, v = live[a]
        scored = sorted((-dot(v, w), i, same == label) for i, (same, w) in live.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [(i, -m) for m, i, same in scored if not same and -low * minus <= -100 * m <= -high * minus]
            out |= {(a, p, k, i, -minus, s) for k, (i, s) in enumerate(fits[:negatives], 1)}
    return out


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(hn, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hn, "STRIPE_BUCKETS", 4)


@pytest.mark.parametrize("case", ["norms", "ties", "large"])
def test_against_brute_force(spark, small, case):
    rnd = random.Random(case)
    rows = []
    for i in range(300):
        size = {"norms": rnd.choice([0.1, 1, 5]), "ties": 1, "large": 3e4}[case]
        v = [rnd.choice([0.0, 0.5, 1.0]) if case == "ties" else size * rnd.gauss(0.4, 1) for _ in range(rnd.choice([6, 6, 6, 4, 0]) if case == "norms" else 6)]
        rows.append((i, rnd.randrange(3), v, 0.5, "x", 1))
    rows += [(rnd.randrange(300), 1, rows[3][2], 0.0, "", 0), rows[5], rows[10], (None, 1, [1.0] * 6, 0.0, "", 0), (401, None, [1.0] * 6, 0.0, "", 0), (400, 1, None, 0.0, "", 0),
             (410, 1, [1.0, None], 0.0, "", 0), (420, 1, [1.0, float("nan")], 0.0, "", 0), (430, 1, [float("inf")] * 6, 0.0, "", 0)]
    rows += [(k, 2, [0.25] * 6, 0.0, "", 0) for k in range(1000, 1060)]  # one very common vector
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hn.hard_negatives(hn.usable(frame), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got} == want
    assert len(got) == len(want) > 50


def test_empty_tables(spark):
    for rows in ([], [(50, 1, [1.0], 0.0, "", 0)], [(1, 1, [1.0], 0.0, "", 0), (2, 2, [1.0], 0.0, "", 0)]):
        assert hn.hard_negatives(hn.usable(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 50 == 0).count() == 0


def test_buckets_that_cannot_matter_are_left_out(spark, small):
    """Norms fall by half a bucket; an anchor's block is dealt only the buckets whose norm can reach its windows."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=8) * 2.0 ** -(i // 16)).tolist(), 0.0, "", 0) for i in range(320)]
    vectors = hn.usable(spark.createDataFrame(rows, SCHEMA))
    buckets = hn._blocks(hn.materialize(vectors, "v"), [F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).desc()], hn.BUCKET_ROWS, "b").toPandas().sort_values("top", ascending=False)
    v = np.floor(256 * np.array(rows[0][2], "f4").astype("f8"))
    block = {"vectors": v.astype("i4").tobytes(), "kind": "i4", "dims": 8, "ids": np.array([999]).tobytes(), "labels": np.array([0]).tobytes()}
    search = hn._Search(block, 5, None)
    read = []
    real = hn._products
    hn._products = lambda *a: read.append(1) or real(*a)
    try:
        for b in buckets.to_dict("records"):
            search.add(b)
    finally:
        hn._products = real
    assert len(read) < len(buckets) / 2
    with pytest.raises(ValueError):
        hn._norms(np.full((1, 3), 2.0**31))
