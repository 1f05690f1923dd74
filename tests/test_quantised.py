"""Product quantisation: recall against exact search, and its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import quantised, search
from cairn.plans import service
from cairn.sources.scratch import scratch


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_table(spark, sf):
    rows = service.vec_pq_recall(spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) > 20 and np.mean([r.recall for r in rows]) >= 0.9


def test_clusters_and_edges(spark, monkeypatch):
    monkeypatch.setattr(quantised, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(20, 10))[rng.integers(0, 20, 1500)] + 0.2 * rng.normal(size=(1500, 10))).astype("f4")
    x[40:60] = x[40]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    path = scratch(spark, "pq")
    books = quantised.write_pq(df, path, "id", "v", 4)
    asked = df.filter(F.col("id") % 60 == 0).select(F.col("id").alias("q"), "v")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    got = quantised.pq_search(read("codes"), read("vectors"), books, asked, 5, 200).collect()
    assert books.shape == (4, 256, 3) and len(got) == 25 * 5
    hits = 0
    for q in range(0, 1500, 60):
        d = ((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1)
        want = sorted(range(1500), key=lambda i: (round(d[i], 9), i))[:5]
        own = [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)]
        hits += len(set(own) & set(want))
    assert hits >= 0.9 * 125
    empty = df.limit(0)
    books = quantised.write_pq(empty, path, "id", "v", 4)
    assert quantised.pq_search(read("codes"), read("vectors"), books, asked, 5).count() == 0
    few = df.limit(3)
    books = quantised.write_pq(few, path, "id", "v", 4)
    assert quantised.pq_search(read("codes"), read("vectors"), books, asked, 5).groupBy("q").count().filter("count = 3").count() == 25


def test_cells_grow_with_the_vectors_and_meet_their_queries_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 6)).astype("f4")
    x[100:400] = x[100]  # a cell of copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    path = scratch(spark, "ivf")
    centres = search.write_ivf(df, path, "id", "v", None)
    assert len(centres) == 50
    monkeypatch.setattr(search, "SLICE_ROWS", 70)
    index = spark.read.parquet(path)
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("q"), "v")
    got = search.ivf_search(index, centres, asked, 4, "id", "v", 50).collect()  # all cells: exact
    plan = search.ivf_search(index, centres, asked, 4, "id", "v", 8)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan  # pairs are compared by blocks
    for q in range(0, 2500, 50):
        d = ((x.astype("f8") - x[q].astype("f8")) ** 2).cumsum(1)[:, -1]
        want = sorted(range(2500), key=lambda i: (d[i], i))[:4]
        own = sorted((r for r in got if r.q == q), key=lambda r: r.rank)
        assert [(r.id, r.distance) for r in own] == [(i, d[i]) for i in want]
    many = rng.integers(-2, 3, size=(300, 3)).astype("f4")  # ties
    far = (many * many).sum(1)[None, :] - 2 * x[:200, :3] @ many.T
    assert (search.nearest_cells(x[:200, :3], many, 8) == np.argsort(far, axis=1, kind="stable")[:, :8]).all()


def test_a_scan_is_exact_in_slices(spark, monkeypatch):
    x = np.random.default_rng(6).integers(-2, 3, size=(300, 4)).astype("f4")  # ties and copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)
    monkeypatch.setattr(search, "SCAN_ROWS", 40)
    got = search.scan_search(df, df.filter("id % 30 = 0").select(F.col("id").alias("q"), "v"), 5, "id", "v").collect()
    for q in range(0, 300, 30):
        d = ((x - x[q]) ** 2).sum(1)
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == sorted(range(300), key=lambda i: (d[i], i))[:5]
