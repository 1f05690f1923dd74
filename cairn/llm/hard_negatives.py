"""Hard negatives: for each anchor and each of its positives, the best rows of other labels whose score lies in a window below the positive's.

Candidates are sorted by norm, longest first, and cut into buckets of BUCKET_ROWS. Anchors are packed into blocks. A task takes one block of anchors
and one stripe of the buckets, longest first: by Cauchy-Schwarz no score in a bucket exceeds |anchor| times the bucket's greatest norm, so an
anchor leaves a bucket out where that product is below the lower limits of its windows or the scores it already has. One search finds the positives
(same label, no lower limit), one the negatives; in the second, anchors are sorted by the norm that a candidate must have, and buckets that no
anchor of a block can use are not even dealt to it. The stripes' results, at most STRIPES times k a window, are merged by anchor.

Vectors of one length (such as normalised ones) leave nothing to prune by norm; the running scores then only save sorting.
The query set is compared with all rows, in blocks: the products grow with anchors times rows. What is shuffled is each bucket once per block of anchors.

Scores are exact: integers in float32 below 2**24, in float64 below 2**53, in int64 beyond; norms of integer vectors of 2**31 or more raise ValueError.

Defined results: rows with a null id or label, a null vector, or any null or non-finite component take no part. Rows that share an id count once: the first by
(label, vector). Shorter vectors count as padded with zeros; an empty vector scores 0. Anchors without a positive or without rows in their windows give no
rows. An empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import freeing, materialize, table

#: Candidates of a bucket; anchors of a block; into how many tasks a block's buckets are dealt at most, and buckets of a task below that.
BUCKET_ROWS, BLOCK_ROWS, STRIPES, STRIPE_BUCKETS = 1024, 2048, 32, 8

_NONE = np.iinfo("i8").min
_PACKED = "pid long, k long, top double, need double, ids binary, labels binary, dims int, kind string, vectors binary, pos_ids binary, pos_scores binary"
_ARROW = pa.schema([
    ("pid", pa.int64()), ("k", pa.int64()), ("top", pa.float64()), ("need", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()),
    ("kind", pa.string()), ("vectors", pa.binary()), ("pos_ids", pa.binary()), ("pos_scores", pa.binary()),
])


def usable(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each id once."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ListArray) -> np.ndarray:
    """floor(256 x) of the vectors, padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return np.floor(256.0 * out)


def _stored(m: np.ndarray) -> tuple[str, bytes]:
    most = np.abs(m).max(initial=0)
    kind = next((k for k, limit in (("i1", 127), ("i2", 2**15 - 1), ("i4", 2**31 - 1)) if most <= limit), "i8")
    return kind, m.astype(kind).tobytes()


def _norms(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    if norms.max(initial=0) >= 2**31:
        raise ValueError("vectors so long that their scores leave 64 bits")
    return norms


def _packer(size: int):
    """Rows (vec_id, label, v[, pos_ids, pos_scores, need]) in order become blocks of ``size``."""

    def block(at: int, rows: pa.Table) -> dict:
        m = _matrix(rows["v"].combine_chunks())
        kind, raw = _stored(m)
        out = {
            "pid": TaskContext.get().partitionId(), "k": at, "top": float(_norms(m).max(initial=0)), "need": 0.0, "ids": rows["vec_id"].to_numpy().astype("i8").tobytes(),
            "labels": rows["label"].to_numpy().astype("i8").tobytes(), "dims": m.shape[1], "kind": kind, "vectors": raw, "pos_ids": b"", "pos_scores": b"",
        }
        if "need" in rows.column_names:
            out["need"] = float(rows["need"].to_numpy().min())
            for c, blank in (("pos_ids", _NONE), ("pos_scores", _NONE)):
                lists = rows[c].to_pylist()
                wide = np.full((len(lists), max(map(len, lists))), blank, "i8")
                for r, own in enumerate(lists):
                    wide[r, : len(own)] = own
                out[c] = wide.tobytes()
        return out

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= size:
                yield pa.RecordBatch.from_pylist([block(at, held.slice(0, size))], schema=_ARROW)
                held, at = held.slice(size), at + 1
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([block(at, held)], schema=_ARROW)

    return run


def _blocks(rows: DataFrame, order: list[Column], size: int, name: str) -> DataFrame:
    """``rows`` (written) sorted by ``order`` over all and packed. A cluster that deals rows over more partitions than asked for would leave
    blocks of a few rows each, so partitions are joined up to the number that full blocks need."""
    ranges = max(1, min(rows.count() // size, 100_000))
    dealt = rows.repartitionByRange(ranges, *order).coalesce(ranges).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(_packer(size), _PACKED), name)


def _vectors(row: dict) -> np.ndarray:
    m = np.frombuffer(row["vectors"], row["kind"])
    return m.reshape(len(row["ids"]) // 8, row["dims"])


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows whose norms' product is at most ``bound``."""
    kind = "f4" if bound < 2**24 else "f8" if bound < 2**53 else "i8"
    n = min(q.shape[1], c.shape[1])
    return q[:, :n].astype(kind) @ c[:, :n].astype(kind).T


class Best:
    """The k best (score, id) of each row so far: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.scores, self.ids = np.full((rows, k), _NONE), np.full((rows, k), np.iinfo("i8").max)

    def least(self) -> np.ndarray:
        """What a candidate must reach."""
        return self.scores[:, -1]

    def offer(self, rows: np.ndarray, s: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores ``s`` of the candidates ``ids`` for ``rows``, where ``fits``."""
        k = self.scores.shape[1]
        fits = fits & (s >= self.least()[rows, None].astype(s.dtype))
        some = fits.any(axis=1)
        if not some.any():
            return
        rows, s, fits = rows[some], s[some], fits[some]
        if s.shape[1] > k:  # no candidate below a row's own k-th score comes in
            low = -np.inf if s.dtype.kind == "f" else _NONE
            kept = np.where(fits, s, low)
            fits &= s >= np.partition(kept, -k, axis=1)[:, -k, None]
        at, col = np.nonzero(fits)
        pairs_row = np.concatenate([rows[at], np.repeat(rows, k)])
        score = np.concatenate([s[at, col].astype("i8"), self.scores[rows].ravel()])
        ident = np.concatenate([ids[col], self.ids[rows].ravel()])
        order = np.lexsort((ident, ~score, pairs_row))
        pairs_row, score, ident = pairs_row[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, pairs_row[1:] != pairs_row[:-1]])
        rank = np.arange(len(pairs_row)) - np.repeat(first, np.diff(np.r_[first, len(pairs_row)]))
        keep = rank < k
        self.scores[pairs_row[keep], rank[keep]] = score[keep]
        self.ids[pairs_row[keep], rank[keep]] = ident[keep]


class _Search:
    """One block of anchors against buckets, longest first."""

    def __init__(self, row: dict, k: int, window: tuple[int, int] | None):
        self.q, self.ids, self.labels, self.window = _vectors(row), np.frombuffer(row["ids"], "i8"), np.frombuffer(row["labels"], "i8"), window
        self.norms, n = _norms(self.q.astype("f8")), len(self.ids)
        if window is None:
            self.best, self.lows, self.highs = [Best(n, k)], [np.full(n, _NONE + 1)], None
            return
        self.pos_ids, self.pos_scores = (np.frombuffer(row[c], "i8").reshape(n, -1) for c in ("pos_ids", "pos_scores"))
        p, low, high = self.pos_scores, *window
        open_ = p >= 0  # below 0 the lower limit is above the upper one
        p = np.where(open_, p, 0)
        self.lows = list(np.where(open_, -((-low * p) // 100), np.iinfo("i8").max).T)
        self.highs = list(np.where(open_, high * p // 100, _NONE).T)
        self.best = [Best(n, k) for _ in self.lows]

    def add(self, bucket: dict) -> None:
        top = bucket["top"]
        bound = self.norms * top * (1 + 1e-9) + 1
        useful = np.zeros(len(self.ids), bool)
        for best, low in zip(self.best, self.lows, strict=True):
            useful |= bound >= np.maximum(low, best.least())
        rows = np.flatnonzero(useful)
        if not len(rows):
            return
        ids, labels = np.frombuffer(bucket["ids"], "i8"), np.frombuffer(bucket["labels"], "i8")
        s = _products(self.q[rows], _vectors(bucket), float(bound[rows].max()))
        same = self.labels[rows, None] == labels[None, :]
        if self.window is None:
            self.best[0].offer(rows, s, same & (self.ids[rows, None] != ids[None, :]), ids)
            return
        for best, low, high in zip(self.best, self.lows, self.highs, strict=True):
            # limits beyond what a score of this kind can hold exactly lie beyond every score
            a, b = (np.clip(x[rows, None], -(2**62), 2**62).astype("f8" if s.dtype.kind == "f" else "i8") for x in (low, high))
            best.offer(rows, s, ~same & (s >= a) & (s <= b), ids)

    def rows(self) -> Iterator[tuple]:
        for w, best in enumerate(self.best):
            at, rank = np.nonzero(best.scores != _NONE)
            anchor, found, score = self.ids[at], best.ids[at, rank], best.scores[at, rank]
            pos = (self.pos_ids[at, w], self.pos_scores[at, w]) if self.window else (np.zeros(len(at), "i8"),) * 2
            yield anchor, *pos, found, score


_FOUND = "anchor_id long, positive_id long, positive_score long, found long, score long"


def _searcher(k: int, window: tuple[int, int] | None):
    names = [x.split()[0] for x in _FOUND.split(", ")]

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = search = None

        def done() -> Iterator[pa.RecordBatch]:
            for columns in search.rows() if search else ():
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for b in batches:
            for at in range(b.num_rows):
                row = {c: b[c][at].as_py() for c in b.schema.names}
                if row["bucket"]:
                    search.add(row)
                    continue
                yield from done()
                now, search = (row["block"], row["stripe"]), _Search(row, k, window)
        del now
        yield from done()

    return run


def _found(anchors: DataFrame, buckets: DataFrame, k: int, window: tuple[int, int] | None) -> DataFrame:
    """Rows of _FOUND: for each anchor (and positive) its k best over all buckets."""
    stripes = max(1, min(STRIPES, -(-buckets.count() // STRIPE_BUCKETS)))
    # one number per block of anchors comes to the driver
    needs = sorted((r["pid"] << 20 | r["k"], r["need"]) for r in anchors.select("pid", "k", "need").toLocalIterator())
    listed = F.from_json(F.lit("[" + ",".join(f'{{"block":{b},"need":{n!r}}}' for b, n in needs) + "]"), "array<struct<block:long,need:double>>")
    own = F.shiftleft(F.col("pid"), 20).bitwiseOR(F.col("k"))
    payload = ["top", "pid", "k", "ids", "labels", "dims", "kind", "vectors", "pos_ids", "pos_scores"]
    left = anchors.select(own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(False).alias("bucket"), *payload)
    stripe = F.pmod(F.xxhash64("pid", "k"), F.lit(stripes)).cast("int")
    wanted = F.filter(listed, lambda x: x["need"] <= F.col("top") * (1 + 1e-9))
    right = buckets.select(F.explode(F.transform(wanted, lambda x: x["block"])).alias("block"), stripe.alias("stripe"), F.lit(True).alias("bucket"), *payload)
    dealt = left.unionByName(right).repartition(max(1, min(len(needs) * stripes, 100_000)), "block", "stripe")
    dealt = dealt.sortWithinPartitions("block", "stripe", "bucket", F.desc("top"), "pid", "k")
    each = dealt.mapInArrow(_searcher(k, window), _FOUND)
    # at most k rows a stripe meet here
    best = each.groupBy("anchor_id", "positive_id", "positive_score").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "found"))), 1, k).alias("best"))
    return best.select("anchor_id", "positive_id", "positive_score", "best")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each row of ``rows`` (vec_id, label, v, as ``usable`` gives them) where ``is_anchor`` and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(rows, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    buckets = _blocks(rows, [norm.desc(), F.col("vec_id")], BUCKET_ROWS, "buckets")
    anchors = materialize(rows.filter(is_anchor), "anchors")
    blocks = _blocks(anchors, [F.col("label"), F.col("vec_id")], BLOCK_ROWS, "blocks")
    near = _found(blocks, buckets, positives, None)
    ids, scores = F.transform("best", lambda x: x["found"]), F.transform("best", lambda x: -x["minus"])
    near = near.select(F.col("anchor_id").alias("vec_id"), ids.alias("pos_ids"), scores.alias("pos_scores"))
    # the norm that a candidate must have: the least lower limit of the windows over the anchor's own norm
    least = F.array_min(F.filter("pos_scores", lambda p: p >= 0))
    whole = F.sqrt(F.aggregate(F.transform("v", lambda x: F.floor(x * 256).cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    need = F.when(least > 0, F.ceil(least * low / 100) / whole).otherwise(F.lit(0.0)) * (1 - 1e-9)
    second = anchors.join(near, "vec_id").filter(least.isNotNull()).withColumn("need", need)
    second = _blocks(materialize(second, "windows"), [F.col("need"), F.col("vec_id")], BLOCK_ROWS, "blocks")
    found = _found(second, buckets, negatives, (low, high))
    each = found.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "x"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.found").alias("negative_id"), "positive_score", (-F.col("x.minus")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(rows.withColumn("label", label)), F.col("vec_id") % 50 == 0)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
