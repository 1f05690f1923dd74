"""Vector search by product quantisation: each vector is kept as one byte for each of its parts, distances to those bytes come from small tables,
and the best are compared again exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.search import IVF_SAMPLE, l2_distance, nearest_cells

#: Centres of a part, rounds of fitting, queries that are looked up together, codes that are looked at together.
CENTRES, ROUNDS, QUERY_BLOCK, CODE_BLOCK = 256, 10, 1024, 2048


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, numbers), filled up with zeros."""
    wide = -(-x.shape[1] // parts) * parts
    out = np.zeros((len(x), wide), "f4")
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, -1)


def fit_codebooks(vectors: DataFrame, id_col: str, vec_col: str, parts: int = 16) -> np.ndarray:
    """(parts, centres, numbers) by k-means for each part, on at most IVF_SAMPLE vectors, those whose ids hash lowest."""
    sample = vectors.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(IVF_SAMPLE).select(vec_col).toPandas()[vec_col]
    if not len(sample):
        return np.zeros((0, 0, 0), "f4")
    x = _parts(np.array(sample.tolist(), "f4"), parts)
    books = []
    for k in range(parts):
        own = x[:, k]
        centres = own[np.linspace(0, len(own) - 1, min(CENTRES, len(own))).astype("i8")].copy()
        for _ in range(ROUNDS):
            at = nearest_cells(own, centres, 1)[:, 0]
            sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
            np.add.at(sums, at, own)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(centres)
    return np.array(books)


def codes_of(vector: Column, books: np.ndarray) -> Column:
    """A byte a part: the number of the nearest centre. The books are bounded: 256 centres a part."""

    def run(vectors: pd.Series) -> pd.Series:
        x = _parts(np.array(vectors.tolist(), "f4").reshape(len(vectors), -1), len(books))
        codes = np.stack([nearest_cells(x[:, k], books[k], 1)[:, 0] for k in range(len(books))], axis=1).astype("u1")
        return pd.Series([c.tobytes() for c in codes])

    return F.pandas_udf(run, "binary")(vector)


def write_pq(vectors: DataFrame, path: str, id_col: str, vec_col: str, parts: int = 16) -> np.ndarray:
    """Codes of every vector (all of one length, none null) and, sorted by id, the vectors themselves; returns the books."""
    books = fit_codebooks(vectors, id_col, vec_col, parts)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    coded = rows.select("id", codes_of(F.col("v"), books).alias("code")) if len(books) else rows.select("id", F.lit(b"").alias("code"))
    coded.write.mode("overwrite").parquet(f"{path}/codes")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vectors")
    return books


def _lookup(books: np.ndarray, names: list, asked: np.ndarray, keep: int):
    """For each query its ``keep`` nearest codes of a task: (q, id, far)."""
    x = _parts(asked, len(books))
    tables = ((x[:, :, None, :] - books[None]) ** 2).sum(-1).astype("f4")  # (queries, parts, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, at, ids = np.full((len(names), keep), np.inf, "f4"), np.zeros((len(names), keep), "i8"), []
        seen = 0
        for b in batches:
            ids.append(b["id"])
            codes = np.frombuffer(b"".join(b["code"].to_pylist()), "u1").reshape(b.num_rows, -1)
            for a in range(0, len(codes), CODE_BLOCK):
                some = codes[a : a + CODE_BLOCK]
                new = reduce(np.add, (tables[:, k][:, some[:, k]] for k in range(tables.shape[1])))
                both = np.concatenate([far, new], axis=1)
                where = np.concatenate([at, np.broadcast_to(seen + a + np.arange(len(some)), new.shape)], axis=1)
                best = np.argpartition(both, keep - 1, axis=1)[:, :keep]
                far, at = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
            seen += len(codes)
        if seen:
            q, col = np.nonzero(np.isfinite(far))
            own = pa.chunked_array(ids).take(pa.array(at[q, col])).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in q.tolist()]), own, pa.array(far[q, col])], names=["q", "id", "far"])

    return run


def pq_search(codes: DataFrame, vectors: DataFrame, books: np.ndarray, queries: DataFrame, k: int, again: int = 100) -> DataFrame:
    """(q, id, distance, rank): for each of ``queries`` (q, v) the nearest k by exact squared distance among the ``again`` nearest by codes. Queries are looked
    up in blocks of some QUERY_BLOCK, each against all codes; a task hands on ``again`` rows a query, and of the vectors only those rows' are read again."""
    kinds = f"q {dict(queries.dtypes)['q']}, id {dict(codes.dtypes)['id']}, far float"
    blocks, found = max(1, -(-queries.count() // QUERY_BLOCK)), []
    dealt = queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("q", "v").collect()
        if rows and len(books):
            found.append(codes.mapInArrow(_lookup(books, [r.q for r in rows], np.array([r.v for r in rows], "f4"), again), kinds))
    if not found:
        return queries.sparkSession.createDataFrame([], kinds.replace("far float", "distance double, rank int"))
    near = reduce(DataFrame.unionByName, found)
    first = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("far", "id"))).filter(F.col("r") <= again).select("q", "id")
    exact = first.join(vectors, "id").join(queries.select("q", F.col("v").alias("asked")), "q").select("q", "id", l2_distance(F.col("v"), F.col("asked")).alias("distance"))
    return exact.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k)
