"""Cycles of plans: small plans in one task each, large ones in rounds, with the same result."""

import random

from cairn.operators import graph


def _edges(seed):
    rng = random.Random(seed)
    return sorted({(p, a, b) for p in range(40) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(14))) if a != b})


def _want(edges):
    reach = {e for e in edges}
    for k in range(9):
        reach |= {(p, a, d) for p, a, b in reach if b == k for q, c, d in reach if q == p and c == k}
    return sorted({(p, a) for p, a, b in reach if a == b})


def test_both_ways_find_the_steps_on_cycles(spark, monkeypatch):
    edges = _edges(5)
    want = _want(edges)
    df = spark.createDataFrame(edges, "plan long, id long, dep long")
    assert sorted(map(tuple, graph.cycles(df, 5).collect())) == want
    monkeypatch.setattr(graph, "_trimmed", None)  # small plans take no rounds
    assert sorted(map(tuple, graph.cycles(df).collect())) == want
    assert graph.cycles(df.limit(0)).collect() == []


def test_a_long_ring_and_a_long_chain(spark):
    n = 20_000
    ring = [(k, (k + 1) % n) for k in range(n)]
    assert sorted(graph._on_cycles(ring)) == list(range(n)) and graph._on_cycles(ring[:-1]) == []
