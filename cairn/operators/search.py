"""Retrieval: BM25, vector and symbol recall, reciprocal-rank fusion, re-ranking. Every ranking has a total order."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions import text as X
from cairn.sources.scratch import materialize

K1, B, RRF_K = 1.5, 0.75, 60


#: Postings of a block; a block is kept or skipped as a whole. Postings of a file. For how many results a term's own impacts bound a
#: list from below. Smallest ids kept with the statistics, from which documents of score 0 are taken.
BLOCK, FILE_POSTINGS, LADDER, RESERVE = 128, 2_000_000, (1, 5, 10, 20, 50, 100, 200, 500, 1000), 1000


class Bm25Index(NamedTuple):
    """An index as written: blocks of postings (term, ids, tf, dl, top), the dictionary (term, df, top, ladder), (id, dl) of documents with
    tokens, and the statistics: n, avgdl, the floor of negative idf, and the smallest ids."""

    blocks: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: Row


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): the inverted index. Counting needs one shuffle, on (id, term). A document without tokens has
    none; the outer form keeps the optimizer from tokenizing twice to test for that."""
    t = docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode_outer("t").alias("term")).filter("term is not null").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_of(df: Column | float, n: Column | float) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _impact(tf, dl, avgdl):
    """What a posting adds to a score, but for its term's weight; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _blocks(avgdl: float):
    """Postings (term, id, tf, dl) in the order of term and falling impact become blocks. The last block of a term's run in a partition bears the run's
    length and ladder: the greatest impact, the 5th greatest and so on, 0 where there are fewer."""

    def pack(held: pa.Table, whole: int) -> Iterator[pa.RecordBatch]:
        """Blocks of the first ``whole`` postings, whose runs are complete."""
        held = held.slice(0, whole).combine_chunks()
        ids, tf, dl = held["id"].combine_chunks(), held["tf"].to_numpy(), held["dl"].to_numpy()
        ends = np.append(_changes(held["term"]), whole)
        starts = np.append(0, ends[:-1])
        size = -(-(ends - starts) // BLOCK)  # blocks of each run
        last = np.cumsum(size) - 1
        run_of = np.repeat(np.arange(len(size)), size)
        first = starts[run_of] + (np.arange(len(run_of)) - (last - size + 1)[run_of]) * BLOCK
        impact = _impact(tf, dl, avgdl)
        at = starts[:, None] + np.array(LADDER)[None, :] - 1
        ladder = np.where(at < ends[:, None], impact[np.minimum(at, whole - 1)], 0.0)
        ladders, run = np.zeros(len(first), bool), np.zeros(len(first), "i8")
        ladders[last], run[last] = True, ends - starts
        offsets = pa.array(np.append(first, whole), "int32")
        cuts = pa.array(np.append(0, np.cumsum(ladders) * len(LADDER)), "int32")
        lists = lambda x: pa.ListArray.from_arrays(offsets, x)
        out = pa.record_batch({
            "term": held["term"].combine_chunks().take(pa.array(first)), "ids": lists(ids), "tf": lists(pa.array(tf, "int64")), "dl": lists(pa.array(dl, "int32")),
            "top": pa.array(np.maximum.reduceat(impact, first)), "run": pa.array(run),
            "ladder": pa.ListArray.from_arrays(cuts, pa.array(ladder.ravel(), "float64"), mask=pa.array(~ladders)),
        })
        for k in range(0, len(first), 2000):
            yield out.slice(k, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, term = [], None  # postings of runs that may go on in the next batch, the last of which is of ``term``
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            if held[1:] and b["term"][0].as_py() == term == b["term"][b.num_rows - 1].as_py():
                continue  # a run of many batches is put together once
            term = b["term"][b.num_rows - 1].as_py()
            both = pa.concat_tables(held)
            cut = _changes(both["term"])
            if len(cut):
                yield from pack(both, int(cut[-1]))
                both = both.slice(int(cut[-1]))
            held = [both]
        if held:
            both = pa.concat_tables(held)
            yield from pack(both, both.num_rows)

    return run


def _changes(term: pa.ChunkedArray) -> np.ndarray:
    """Where a term differs from the one before it."""
    codes = term.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def write_bm25(docs: DataFrame, path: str, id_col: str, text_col: str) -> Bm25Index:
    """Each text is tokenized once; lengths, blocks, the dictionary and the floor come from the written postings. The number of files comes from
    the number of postings, and files are cut by term and impact, so that a frequent term lies in many; its blocks come with falling impact."""
    spark = docs.sparkSession
    flat = materialize(postings(docs, id_col, text_col), "postings")
    flat.groupBy("id").agg(F.max("dl").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    files = max(1, -(-flat.count() // FILE_POSTINGS))
    kind = flat.schema["id"].dataType.simpleString()
    falling = (-_impact(F.col("tf"), F.col("dl"), F.lit(size.avgdl))).alias("falling")
    keyed = flat.select("term", "id", "tf", "dl", falling)
    dealt = keyed.repartitionByRange(max(files, min(spark.sparkContext.defaultParallelism, 16)), "term", "falling", "id").sortWithinPartitions("term", "falling", "id").drop("falling")
    packed = dealt.mapInArrow(_blocks(size.avgdl or 1.0), f"term string, ids array<{kind}>, tf array<long>, dl array<int>, top double, run long, ladder array<double>")
    packed.write.mode("overwrite").parquet(f"{path}/blocks")
    runs = spark.read.parquet(f"{path}/blocks").filter("ladder is not null")
    whole = runs.groupBy("term").agg(F.sum("run").alias("df"), *[F.max(F.col("ladder")[k]).alias(f"l{k}") for k in range(len(LADDER))])
    terms = whole.select("term", "df", F.col("l0").alias("top"), F.array(*[f"l{k}" for k in range(len(LADDER))]).alias("ladder"))
    terms.repartitionByRange(max(1, files // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    floor = spark.read.parquet(f"{path}/terms").agg((F.avg(idf_of(F.col("df"), F.lit(size.n))) * 0.25).alias("floor")).first().floor
    reserve = [r.id for r in lengths.select("id").orderBy("id").limit(RESERVE).collect()]
    stats = spark.createDataFrame([(size.n, size.avgdl, floor, reserve)], f"n long, avgdl double, floor double, reserve array<{kind}>")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return read_bm25(spark, path)


def read_bm25(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{part}") for part in ("blocks", "terms", "lengths")), spark.read.parquet(f"{path}/stats").first())


def term_weights(query: list[str], df: dict[str, int], n: int, floor: float) -> dict[str, float]:
    """Weight of each term of the query that the index has; one that the query repeats counts each time."""
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    return {w: times * (floor if idf[w] < 0 else idf[w]) for w, times in Counter(query).items() if w in idf}


def bm25_blocks(index: Bm25Index, query: list[str], k: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Blocks of the query's terms, and the terms' weights. With ``k``, only blocks that may hold one of the k best documents: the dictionary tells what
    score the k-th best has at least, by one term alone, and a block whose greatest impact, with the other terms at their greatest, stays below
    that is left out by the file source. Of the documents in such a block none is among the k best, and what is left of their scores only falls."""
    words = sorted(set(query))
    known = {r.term: r for r in index.terms.filter(F.col("term").isin(*words)).collect()}
    weight = term_weights(query, {w: r.df for w, r in known.items()}, index.stats.n, index.stats.floor)
    positive = all(x >= 0 for x in weight.values())
    wanted = F.lit(False)
    steps = [i for i, size in enumerate(LADDER) if k is not None and size >= k]
    least = max((weight[w] * known[w].ladder[steps[0]] for w in weight), default=0.0) if steps and positive else 0.0
    for w, x in weight.items():
        others = sum(weight[v] * known[v].top for v in weight if v != w)
        enough = (least - others - 1e-8) / x if x > 0 else 0.0  # scores are compared to nine places
        wanted = wanted | ((F.col("term") == w) & (F.col("top") >= enough) if enough > 0 else F.col("term") == w)
    return index.blocks.filter(wanted), weight


def bm25_hits(index: Bm25Index, query: list[str], k: int | None = None) -> tuple[DataFrame, bool]:
    """(id, part): what each posting of the query's terms adds to its document's score, of the blocks that ``bm25_blocks`` gives; and whether no
    part is negative."""
    blocks, weight = bm25_blocks(index, query, k)
    positive = all(x >= 0 for x in weight.values())
    rows = blocks.select("term", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p"))
    of = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term")) if weight else F.lit(0.0)
    return rows.select(F.col("p.ids").alias("id"), (of * _impact(F.col("p.tf"), F.col("p.dl"), F.lit(index.stats.avgdl))).alias("part")), positive


def bm25_scores(index: Bm25Index, query: list[str]) -> DataFrame:
    """(id, score) of the documents that have a term of the query."""
    return bm25_hits(index, query)[0].groupBy("id").agg(F.sum("part").alias("score"))


def bm25_topk(index: Bm25Index, query: list[str], k: int, drop_zero: bool = False) -> DataFrame:
    """The best k documents; those without a term of the query have score 0 and fill the list, unless ``drop_zero``. Since at most k documents
    stand before them, the k smallest ids are enough to fill it; they are kept with the statistics up to RESERVE."""
    hits, positive = bm25_hits(index, query, k)
    if drop_zero:
        scored = hits.groupBy("id").agg(F.sum("part").alias("score")).filter("score > 0")
    elif positive and 0 < min(k, index.stats.n) <= len(index.stats.reserve):
        kind = index.lengths.schema["id"].dataType
        rest = hits.sparkSession.range(1, numPartitions=1).select(F.explode(F.lit(index.stats.reserve[:k]).cast(T.ArrayType(kind))).alias("id"), F.lit(0.0).alias("part"))
        scored = hits.unionByName(rest).groupBy("id").agg(F.sum("part").alias("score"))
    else:
        every = index.lengths.select("id", F.lit(0.0).alias("part"))
        scored = hits.unionByName(every).groupBy("id").agg(F.sum("part").alias("score")).filter("score >= 0")
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def l2_distance(a: Column, b: Column, squared: bool = True) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return d if squared else F.sqrt(d)


def vec_l2_topk(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str, squared: bool = True) -> DataFrame:
    d = l2_distance(F.col(vec_col), F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")"), squared)
    return vectors.select(F.col(id_col).alias("id"), d.alias("distance")).orderBy("distance", "id").limit(k).withColumn("score", 1 / (1 + F.col("distance")))


#: Vectors that the cells are fitted on at most (those whose ids hash lowest), rounds, and cells at most.
IVF_SAMPLE, IVF_ROUNDS, IVF_CELLS = 20_000, 12, 4096


def fit_cells(vectors: DataFrame, id_col: str, vec_col: str, cells: int) -> np.ndarray:
    """Centres of ``cells`` cells by k-means on a bounded sample; the first centres are spread over the sample."""
    cells = min(IVF_CELLS, cells)
    sample = vectors.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(IVF_SAMPLE).select(vec_col).toPandas()[vec_col]
    x = np.array(sample.tolist(), "f4").reshape(len(sample), -1)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype("i8")].copy()
    for _ in range(IVF_ROUNDS if len(x) else 0):
        own = nearest_cells(x, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, in order; ties go to the smaller number."""
    size, out = (centres * centres).sum(1)[None, :], np.empty((len(x), min(n, len(centres))), "i8")
    step = max(1, 4_000_000 // max(1, len(centres)))
    for a in range(0, len(x), step):
        far = size - 2 * x[a : a + step] @ centres.T
        if n == 1:
            out[a : a + step, 0] = far.argmin(1)
            continue
        if n >= len(centres):
            out[a : a + step] = np.argsort(far, axis=1, kind="stable")
            continue
        near = np.sort(np.argpartition(far, n - 1, axis=1)[:, :n], axis=1)
        own = np.take_along_axis(far, near, 1)
        out[a : a + step] = np.take_along_axis(near, np.argsort(own, axis=1, kind="stable"), 1)
        tied = np.flatnonzero((far <= own.max(1)[:, None]).sum(1) > n)
        out[a + tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :n]
    return out


def _cells_of(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The numbers of the ``n`` nearest cells. The centres are bounded: IVF_CELLS rows."""

    def run(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), "f4").reshape(len(vectors), -1)
        return pd.Series(list(nearest_cells(x, centres, n).astype("i4"))) if len(x) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<int>")(vector)


def write_ivf(vectors: DataFrame, path: str, id_col: str, vec_col: str, cells: int | None = 64) -> np.ndarray:
    """Every vector (column ``vec_col``, all of one length) in the folder of its nearest cell; returns the centres. Without ``cells`` there are as many
    as the root of the number of vectors, 32 at least."""
    cells = cells or max(32, math.isqrt(vectors.count()))
    centres = fit_cells(vectors, id_col, vec_col, cells)
    placed = vectors.withColumn("cell", F.element_at(_cells_of(F.col(vec_col), centres, 1), 1))
    placed.repartition("cell").sortWithinPartitions(id_col).write.mode("overwrite").partitionBy("cell").parquet(path)
    return centres


def ivf_topk(index: DataFrame, centres: np.ndarray, query: list[float], k: int, id_col: str, vec_col: str, probe: int = 8, where: Column | None = None) -> DataFrame:
    """As vec_l2_topk among the vectors of the ``probe`` nearest cells; other cells are not read. ``where`` filters before the
    ranking, and reaches the files."""
    near = nearest_cells(np.array([query], "f4"), centres, probe)[0].tolist()
    some = index.filter(F.col("cell").isin(near))
    return vec_l2_topk(some if where is None else some.filter(where), query, k, id_col, vec_col)


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, id_col: str, vec_col: str, probe: int = 8) -> DataFrame:
    """(q, id, distance, rank): the best k of the ``probe`` nearest cells for each of ``queries`` (q, v). Queries travel to the cells. Cells of more than
    SLICE_ROWS vectors are cut into slices; a slice's vectors meet its queries in one task, which holds the vectors, compares blocks
    of queries by matrix products and hands on k rows a query."""
    own = index.select("cell", F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return _within_cells(own, queries.select("q", "v", F.explode(_cells_of(F.col("v"), centres, probe)).alias("cell")), k, SLICE_ROWS)


def scan_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """As ``ivf_search`` of all vectors. Work grows with vectors times queries, which nothing can help; what a task holds does not, and k rows a query and
    slice leave it."""
    own = vectors.select(F.lit(0).alias("cell"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return _within_cells(own, queries.select("q", "v", F.lit(0).alias("cell")), k, SCAN_ROWS)


def _within_cells(own: DataFrame, queries: DataFrame, k: int, rows: int) -> DataFrame:
    sizes = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("slices"))  # one row a cell
    asked = queries.join(F.broadcast(sizes), "cell")
    held = own.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), F.lit(None).cast(queries.schema["q"].dataType).alias("q"), "id", "v", F.lit(False).alias("asks"))
    sent = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"), "q", F.lit(None).cast(own.schema["id"].dataType).alias("id"), "v", F.lit(True).alias("asks"))
    dealt = held.unionByName(sent).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "asks")
    pairs = dealt.mapInArrow(_meet(k), f"q {dict(queries.dtypes)['q']}, id {dict(own.dtypes)['id']}, distance double")
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Vectors of a cell, and of a scan, that meet queries in one task; pairs that are compared at once, and whose distances are taken exactly at once.
SLICE_ROWS, SCAN_ROWS, PAIRS, EXACT_PAIRS = 10_000, 50_000, 2_500_000, 50_000


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(v), -1)


def _meet(k: int):
    """Of rows (cell, slice, q, id, v, asks), sorted so that a slice's vectors come before its queries: (q, id, distance), the k nearest for each query, ties by
    id. A matrix product finds what may be among them, up to rounding; the distances that decide are summed number by number, as l2_distance does."""

    def near(v: np.ndarray, ids: pa.Array, w: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = (w * w).sum(1)
        far = sizes[None, :] - 2 * v @ w.T
        room = 1e-9 * (1 + (v * v).sum(1) + sizes.max())
        last = np.partition(far, min(k, len(w)) - 1, axis=1)[:, min(k, len(w)) - 1]
        row, col = np.nonzero(far <= (last + room)[:, None])
        exact = np.empty(len(row))
        for a in range(0, len(row), EXACT_PAIRS):
            d = w[col[a : a + EXACT_PAIRS]] - v[row[a : a + EXACT_PAIRS]]
            exact[a : a + EXACT_PAIRS] = np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else 0
        order = np.lexsort((col, exact, row))  # vectors stand in the order of their ids
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], col[best], exact[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, w = None, [], None, None
        for b in batches:
            keys = np.stack([b[c].to_numpy(zero_copy_only=False).astype("i8") for c in ("cell", "slice", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]) if len(keys) else ():
                part, (cell, slice_, asks) = b.slice(a, e - a), keys[a].tolist()
                if (cell, slice_) != now:
                    now, held, ids = (cell, slice_), [], None
                if not asks:
                    held.append(part)
                    continue
                if not held:  # a cell without vectors
                    continue
                if ids is None:
                    whole = pa.Table.from_batches(held).sort_by("id").combine_chunks()
                    ids, w = whole["id"].combine_chunks(), _matrix(whole["v"].combine_chunks())
                step = max(1, PAIRS // len(w))
                for x in range(0, part.num_rows, step):
                    some = part.slice(x, step)
                    row, col, exact = near(_matrix(some["v"]), ids, w)
                    yield pa.RecordBatch.from_arrays([some["q"].take(pa.array(row)), ids.take(pa.array(col)), pa.array(exact)], names=["q", "id", "distance"])

    return run


def symbol_scores(symbols: DataFrame, tokens: list[str], name: str, contains: bool = True) -> DataFrame:
    """Rows of ``symbols`` that a token names exactly (1.0), as a prefix (0.5) or within (0.3), with score. The tokens of
    one query are literals, so this is a filter."""
    n = F.lower(F.col(name))
    best = F.greatest(F.lit(0.0), *[
        F.when(n == t.lower(), 1.0).when(F.startswith(n, F.lit(t.lower())), 0.5).when(F.lit(contains and len(t) >= 3) & F.contains(n, F.lit(t.lower())), 0.3).otherwise(0.0)
        for t in tokens
    ])
    return symbols.withColumn("score", best).filter("score > 0")


def symbol_topk(symbols: DataFrame, tokens: list[str], k: int, name: str, tie: list[str], contains: bool = True) -> DataFrame:
    return symbol_scores(symbols, tokens, name, contains).orderBy(F.desc("score"), F.length(name), *tie).limit(k)


def symbol_definition(symbols: DataFrame, token: str, name: str, ordinal: str) -> DataFrame:
    return symbols.filter(F.lower(name) == token.lower()).orderBy(ordinal).limit(1)


def rrf_fuse(ranked: DataFrame, k: int = 30) -> DataFrame:
    """``ranked`` (path_ord, path, id, rank) to (id, rrf_score, sources): one shuffle on id, none where the lists are in one partition."""
    fused = ranked.groupBy("id").agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf_score"), F.min(F.struct("path_ord", "rank")).alias("first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("path_ord", "path"))), lambda s: s["path"])).alias("sources"),
    )
    return fused.orderBy(F.desc(F.round("rrf_score", 12)), "first.path_ord", "first.rank").limit(k).drop("first")


def ranked_list(top: DataFrame, path_ord: int, path: str, order: list[Column]) -> DataFrame:
    """A top-k result as a ranked list; the window sees the k rows only."""
    return top.select(F.lit(path_ord).alias("path_ord"), F.lit(path).alias("path"), "id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def local_rows(like: DataFrame, rows: list[Row]) -> DataFrame:
    """``rows`` of ``like`` as a relation in the plan."""
    schema = to_arrow_schema(like.schema)
    return like.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema), like.schema)


#: Candidates that are looked up by their ids; beyond, candidates and chunks are joined.
FEW = 1000


def enrich_candidates(fused: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with ``columns`` of their chunks (id, ...; each id once), where they have no value of their own. Up to FEW candidates are read first, and
    their ids reach the chunks' files as a filter; more of them are joined with the chunks."""
    own, found = [c for c in columns if c in fused.columns], chunks.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    rows = fused.limit(FEW + 1).collect()
    if rows and len(rows) <= FEW:
        fused = local_rows(fused, rows)
        found = F.broadcast(found.filter(F.col("id").isin(*{r.id for r in rows if r.id is not None})))
    filled = fused.join(found, "id", "left")
    return filled.select(*[c for c in fused.columns if c not in own], *[(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) if c in own else F.col(f"__{c}")).alias(c) for c in columns])


def overlap_score(tokens: list[str], text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: the default scorer."""
    q = sorted(set(tokens))
    return F.size(F.array_intersect(F.array(*map(F.lit, q)), X.tokenize(text))) / float(max(1, len(q)))


def rerank_topk(candidates: DataFrame, scorer: Column | None, k: int = 5, limit: int = 10, late: Column | None = None) -> DataFrame:
    """The first ``limit`` candidates by rrf_score, re-scored; the others are dropped. One candidate or none is not re-scored
    (status skipped). Without a scorer (unavailable), or where one of the scores came too late (``late`` true: timeout), the order
    is that of the fusion."""
    head = candidates.orderBy(F.desc(F.round("rrf_score", 12)), "id").limit(limit)
    whole = W.partitionBy()  # the limit's rows
    status = F.when(F.col("n") <= 1, "skipped").when(F.lit(scorer is None), "unavailable").when(F.col("slow"), "timeout").otherwise("reranked")
    slow = F.lit(False) if late is None else F.coalesce(F.bool_or(late).over(whole), F.lit(False))
    scored = head.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("slow", slow).withColumn("status", status)
    own = F.lit(None).cast("double") if scorer is None else scorer
    scored = scored.withColumn("rerank_score", F.when(F.col("status") == "reranked", own)).drop("n", "slow")
    return scored.orderBy(F.desc(F.coalesce("rerank_score", "rrf_score")), F.desc(F.round("rrf_score", 12)), "id").limit(k)


def hit_at_k(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mean over queries (q) of whether any of its results is relevant."""
    hit = results.join(relevant, ["q", "id"], "left_semi").select("q").distinct().withColumn("hit", F.lit(1.0))
    return results.select("q").distinct().join(hit, "q", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hit_at_k"))


def passages_in(passages: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """(q, id) of passages (q, passage) that a document (id, text) contains, character by character. Texts meet on a hash of a
    passage's first ``words`` whole words, and the pairs that meet are compared. A passage of fewer whole words than that is
    known by as many as it has; one without any is compared with every document."""
    cut = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    inner = F.slice(cut("passage"), 2, F.greatest(F.size(cut("passage")) - 2, F.lit(0)))  # the outer words may be parts of words
    key = F.slice(inner, 1, words)
    asked = passages.select("q", "passage", key.alias("key")).withColumn("size", F.size("key"))
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # at most words + 1 numbers
    own = docs.select("id", "text", cut("text").alias("w"))
    found = None
    for n in sorted(sizes):
        some = asked.filter(F.col("size") == n)
        if n:
            starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
            grams = F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice("w", k, F.lit(n)))))
            have = own.select("id", "text", F.explode(grams).alias("h"))
            pairs = have.join(some.select("q", "passage", F.xxhash64("key").alias("h")), "h")
        else:
            pairs = own.crossJoin(some.select("q", "passage"))
        hit = pairs.filter(F.contains("text", F.col("passage"))).select("q", "id")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct() if found is not None else passages.select("q", F.lit(None).alias("id")).limit(0)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``qs``): exact quantiles, interpolated between neighbours; nulls do not count. Rows are dealt by ranges of (by, value) and written;
    the counts of the ranges tell in which of them a rank lies, and only those ranges are ranked, each by itself. So a group of any size is spread
    over all tasks, and what is added up is no larger than the number of ranges."""
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("all"), *by).alias("g"), F.col(value).cast("double").alias("v"))
    dealt = materialize(rows.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranges")
    counts = materialize(dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("own")), "counts")
    upto = counts.withColumn("end", F.sum("own").over(W.partitionBy("g").orderBy("part"))).withColumn("n", F.sum("own").over(W.partitionBy("g")))
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for name, q in qs.items()])).alias("x")
    ranks = upto.select("g", "part", "own", "end", at).select("g", "part", "own", "end", "x.*").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    held = ranks.filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("own")))
    held = materialize(held.select("g", "part", "q", "at", "rank", (F.col("rank") - F.col("end") + F.col("own") + 1).cast("int").alias("place")), "held")
    some = dealt.join(F.broadcast(held.select("g", "part").distinct()), ["g", "part"], "left_semi")  # two ranges a quantile and group at most
    placed = some.withColumn("place", F.row_number().over(W.partitionBy("g", "part").orderBy("v"))).join(held, ["g", "part", "place"])
    low, high = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    each = placed.groupBy("g", "q").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("v"))
    return each.groupBy("g").agg(*[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in qs]).select("g.*", *qs).drop("all")


def latency_report(df: DataFrame, value: str, error: Column) -> DataFrame:
    """One row: mean, exact quantiles, extremes, and the number of errors; nulls and 0 for an empty table."""
    whole = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.coalesce(F.sum(error.cast("long")), F.lit(0)).alias("errors"))
    parts = exact_quantiles(df, [], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return whole.join(F.broadcast(parts), F.lit(True), "left").select("mean", "p50", "p95", "p99", "max", "min", "errors")  # one row beside one
