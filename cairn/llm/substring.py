"""Substring dedup: words covered by a window of WINDOW words that also starts in a document with a smaller id go.

Windows are judged by an FM-index per shard: passages that may repeat are laid into the index of the shard that their first document falls to, and
documents are streamed against it; backward search over the wavelet matrix gives the matching statistics of every place, cut off at the window's
length, and with them the least document of the index that holds the window. Intervals above the threshold are reported as spans.

What has to be indexed and streamed is found in two filters, of which the first keeps the second small. A window's anchor is the least hash of its
GRAM-word shingles; windows in a row with one anchor make a run, about one for 16 words, and only anchors are counted over all documents. Windows of
runs whose anchor occurs in two documents are then hashed and counted themselves. Each window that repeats has a first document, its owner: an
owner's windows are indexed once however many copies there are, and the windows of other documents are streamed to their owner's shard.
A shard holds at most some INDEX_WORDS words (and at least one passage); one that many documents stream to is laid out in as many tasks as STREAM_WORDS asks
for, each with the same index, so that neither a passage nor a document that many others copy gathers in one task. Hashes of 64 bits only choose
what is looked at; words decide. (Two windows of equal hash and different words could hide the later one's owner: one chance in 2**64 a pair.)

Defined results: null or empty text has no words. A window is judged on the input, not on what is left. A null id is larger than all others; two null
ids, or rows that repeat an id, are not smaller than each other, so neither removes words of the other. A document's own repeats stay. Documents of fewer
words than the window stay whole. A document's words are held by one task. An empty table gives an empty result. Other columns are not
looked at, whatever their names. ``docs`` may be any plan whose rows do not change from one evaluation to the next; their order may.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACES, field, free_name, freeing, materialize, table, text_of
from cairn.llm.fm_index import FMIndex
from cairn.llm.rows import BROADCAST_LOG2, filter_log2, flagged, keyed, meeting, words_set

WINDOW, GRAM = 50, 20
#: Words of a shard's index; words streamed to one task; words of one streamed passage; bytes hashed together.
INDEX_WORDS, STREAM_WORDS, PASSAGE_WORDS, TOGETHER = 300_000, 2_000_000, 400, 1 << 20
#: Streamed words that are searched in step.
IN_STEP = 300_000

_BASE = 0x9E3779B97F4A7C15


def shingle_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` of the hashes ``x``: a polynomial put together from runs of powers of two, then mixed."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    total, done, piece, size = np.zeros(n, "u8"), 0, x, 1
    while True:
        if k & size:
            total = total * np.uint64(pow(_BASE, size, 1 << 64)) + piece[done : done + n]
            done += size
        if size * 2 > k:
            break
        piece = piece[: len(piece) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + piece[size:]
        size *= 2
    return _mixed(total)


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` values in a row."""
    n, size = len(x) - k + 1, 1
    while size * 2 <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[k - size : k - size + n])


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_tables: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers and those of its inverse; kept for blocks of ordinary size."""
    if len(_tables[0]) >= n:
        return _tables
    made = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, "u8")]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n <= 4 * TOGETHER:
        _tables[:] = made
    return made


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in a row, and the number of the word with which each text begins (and the number of all): a polynomial over a
    word's bytes, from sums over all bytes, so that no word is handled by itself."""
    raw = np.frombuffer(b" ".join([*texts, b""]), "u1")
    if not len(raw):
        return np.zeros(0, "u8"), np.zeros(len(texts) + 1, "i8")
    space = _SPACE[raw]
    inside = ~space
    begin = np.flatnonzero(inside & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, inside[:-1]])
    power, inverse = _powers(len(raw) + 1)
    sums = np.cumsum((raw.astype("u8") + np.uint64(1)) * power[: len(raw)])
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return _mixed((sums[end - 1] - before) * inverse[begin]), np.searchsorted(begin, starts)


def _together(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """As many texts at a time as hold TOGETHER bytes: (number of the first text, texts)."""
    first, held, n = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or b"")
        n += len(held[-1])
        if n >= TOGETHER:
            yield first, held
            first, held, n = at + 1, [], 0
    if held:
        yield first, held


def _anchors(window: int, gram: int):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.select(["k1", "k2", "id"])
            for first, held in _together(b["text"].to_pylist()):
                x, starts = word_hashes(held)
                if len(x) < window:
                    continue
                least = sliding_least(shingle_hashes(x, gram), window - gram + 1)
                doc = np.repeat(np.arange(len(held)), np.diff(starts))
                whole = doc[: len(least)] == doc[window - 1 :]
                cut = np.flatnonzero(whole & np.r_[True, (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1 : len(least)] != doc[: len(least) - 1])])
                ends = np.concatenate([[0], np.cumsum(whole)])  # windows up to each place
                size = np.diff(np.r_[ends[cut], ends[-1]])
                own = keys.slice(first).take(pa.array(doc[cut]))
                yield pa.RecordBatch.from_arrays(
                    [own["k1"], own["k2"], own["id"], pa.array(least[cut].view("i8")), pa.array((cut - starts[doc[cut]]).astype("i4")), pa.array(size.astype("i4"))],
                    names=["k1", "k2", "id", "anchor", "start", "n"],
                )

    return run


def _windows(window: int):
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, keys = b["spans"].to_pylist(), b.select(["doc", "id"])
            for first, held in _together(b["text"].to_pylist()):
                x, starts = word_hashes(held)
                h = shingle_hashes(x, window)
                pieces = [(k, starts[k] + s["start"], s["n"]) for k in range(len(held)) for s in spans[first + k]]
                if not pieces:
                    continue
                sizes = np.array([n for *_, n in pieces])
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([s for _, s, _ in pieces], sizes)
                doc = np.repeat([k for k, *_ in pieces], sizes)
                own = keys.slice(first).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view("i8")), own["doc"], own["id"], pa.array((at - starts[doc]).astype("i4"))], names=["w", "doc", "id", "pos"])

    return run


@freeing
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, owner, pos) in order become runs of windows with one owner: start, end (behind the last window's start)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        change = _changes(held)
        if len(change) > 1:  # the last run may go on in the next batch
            yield from _runs(held.slice(0, change[-1]), change[:-1])
            held = held.slice(change[-1])
    if held is not None and held.num_rows:
        yield from _runs(held, _changes(held))


def _changes(t: pa.Table) -> np.ndarray:
    doc, pos = (t[c].to_numpy() for c in ("doc", "pos"))
    owner = t["owner"].combine_chunks().dictionary_encode()
    owner = (owner.combine_chunks() if isinstance(owner, pa.ChunkedArray) else owner).indices.to_numpy()
    step = pos[1:] - pos[:-1]  # 0: a repeated row
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (step < 0) | (step > 1)])


def _runs(t: pa.Table, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    pos = t["pos"].to_numpy()
    last = np.r_[change[1:], t.num_rows] - 1
    own = t.take(pa.array(change)).combine_chunks().to_batches()[0]
    yield pa.RecordBatch.from_arrays([own["doc"], own["owner"], pa.array(pos[change]), pa.array(pos[last] + 1)], names=["doc", "owner", "start", "end"])


def _cut_out(window: int, longest: int):
    """Passages' words, joined by a space: of those that are streamed, in pieces of at most ``longest`` words that share window - 1."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "task", "streamed", "k1", "k2", "id", "start", "words"]
        for b in batches:
            keys, spans, rows, picked = b.select(["k1", "k2", "id"]), b["spans"].to_pylist(), [], []
            for at, text in enumerate(b["text"].to_pylist()):
                words = (text or b"").split()
                for s in spans[at]:
                    step = longest - window + 1
                    for start in range(s["start"], s["end"], step):
                        end = min(s["end"], start + step)
                        picked.append(at)
                        rows.append((s["shard"], s["task"], s["streamed"], start, b" ".join(words[start : end + window - 1])))
            for k in range(0, len(rows), 5000):
                part = list(zip(*rows[k : k + 5000], strict=True))
                own = keys.take(pa.array(picked[k : k + 5000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.bool_()), own["k1"], own["k2"], own["id"], pa.array(part[3], pa.int32()), pa.array(part[4], pa.binary())], names=names
                )

    return run


def _search(window: int):
    """Passages by (shard, task), the indexed ones before the streamed ones, become spans of words (k1, k2, start, end)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = index = None
        texts, owners, waiting, n = [], [], [], 0

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal index, texts, owners, waiting, n
            if index is None:
                index = FMIndex(texts, owners, window)
                texts, owners = [], []
            different = {}
            for *_, words in waiting:  # copies are searched once
                different.setdefault(words, len(different))
            least = index.matching_statistics([w.split(b" ") for w in different])
            out = []
            for k1, k2, ident, start, words in waiting:
                found = least[different[words]]
                gone = np.flatnonzero((found >= 0) & (found < index.before_document(ident)))
                if len(gone):
                    first = np.r_[True, np.diff(gone) > window]
                    ends = gone[np.r_[first[1:], True]] + window
                    out += [(k1, k2, start + int(a), start + int(e)) for a, e in zip(gone[first], ends, strict=True)]
            waiting, n = [], 0
            if out:
                part = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "start", "end"])

        for b in batches:
            for shard, task, streamed, k1, k2, ident, start, words in zip(*(b[c].to_pylist() for c in b.schema.names), strict=True):
                if now != (shard, task):
                    if waiting:
                        yield from look()
                    now, index, texts, owners = (shard, task), None, [], []
                if not streamed:
                    texts.append(words.split(b" "))
                    owners.append(ident)
                    continue
                waiting.append((k1, k2, ident, start, words))
                n += words.count(b" ") + 1
                if n >= IN_STEP:
                    yield from look()
        if waiting:
            yield from look()

    return run


def _repeated(rows: DataFrame, by: str) -> DataFrame:
    """(by, owner): the values that occur in two documents, one of which has the smaller id."""
    seen = rows.groupBy(by).agg(F.min("id").alias("owner"), F.max("id").alias("most"), F.max(F.col("id").isNull().cast("int")).alias("nameless"))
    return seen.filter("owner is not null and (owner <> most or nameless = 1)").select(by, "owner")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col)


def _fields(id_col: str, text_col: str) -> list[Column]:
    return ["k1", "k2", F.col(field(id_col)).alias("id"), text_of(field(text_col)).cast("binary").alias("text")]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans): for each document that loses words, by its key of id and text, the spans (start, end) of its words that go,
    in order and apart."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    key = f"k1 long, k2 long, id {kind}"
    texts = _rows(docs, id_col, text_col).select(*_fields(id_col, text_col))
    runs = materialize(texts.mapInArrow(_anchors(window, gram), f"{key}, anchor long, start int, n int"), "runs")
    anchors = materialize(_repeated(runs, "anchor").select("anchor"), "anchors")
    log2 = min(filter_log2(anchors.count()), BROADCAST_LOG2)
    words = materialize(words_set(anchors.select(F.xxhash64("anchor").alias("h")), log2), "filter")
    met = flagged(runs, F.xxhash64("anchor"), words, log2).filter("maybe").join(anchors, "anchor", "left_semi")
    spans = met.groupBy("k1", "k2").agg(F.first("id").alias("own"), F.collect_set(F.struct("start", "n")).alias("spans"))
    # windows are many, so their rows bear a short number of the document
    spans = materialize(spans.withColumn("doc", F.monotonically_increasing_id()), "spans")
    near = meeting(_rows(docs, id_col, text_col), spans).select(*_fields(id_col, text_col), "spans", "doc")
    windows = materialize(near.mapInArrow(_windows(window), f"w long, doc long, id {kind}, pos int"), "windows")
    owners = materialize(_repeated(windows, "w"), "owners")
    owned = windows.select("w", "doc", "pos").join(owners, "w").select("doc", "owner", "pos")
    owned = owned.repartition("doc").sortWithinPartitions("doc", "pos")
    runs = materialize(owned.mapInArrow(_segments, f"doc long, owner {kind}, start int, end int"), "segments")
    parts = runs.join(spans.select("doc", "k1", "k2", F.col("own").alias("id")), "doc")
    own = F.coalesce(F.col("id") == F.col("owner"), F.lit(False))
    size = F.col("end") - F.col("start") + window - 1
    indexed = parts.agg(F.sum(F.when(own, size))).first()[0] or 0
    shards = max(1, -(-indexed // INDEX_WORDS))
    parts = parts.select("k1", "k2", "start", "end", (~own).alias("streamed"), F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), size.alias("size"))
    tasks = parts.filter("streamed").groupBy("shard").agg(F.ceil(F.sum("size") / STREAM_WORDS).cast("int").alias("tasks"))
    parts = parts.join(tasks, "shard")  # a shard that nothing is streamed to has nothing to find
    dealt = F.when(F.col("streamed"), F.array(F.pmod(F.xxhash64("k1", "k2", "start"), F.col("tasks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))
    parts = parts.withColumn("task", F.explode(dealt))
    wanted = materialize(parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "streamed", F.col("shard").cast("long").alias("shard"), "task")).alias("spans")), "passages")
    near = meeting(_rows(docs, id_col, text_col), wanted).select(*_fields(id_col, text_col), "spans")
    passages = near.mapInArrow(_cut_out(window, max(PASSAGE_WORDS, 2 * window)), f"shard long, task int, streamed boolean, {key}, start int, words binary")
    passages = passages.repartition("shard", "task").sortWithinPartitions("shard", "task", "streamed")
    found = materialize(passages.mapInArrow(_search(window), "k1 long, k2 long, start int, end int"), "found")
    return materialize(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "repeats")


@freeing
def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
            words = (text or b"").split()
            if spans:
                stays = np.ones(len(words), bool)
                for s in spans:
                    stays[s["start"] : s["end"]] = False
                kept = list(itertools.compress(words, stays))
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n", "gone", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words and n_removed behind the other columns (or those with underscores behind them where the caller has a column
    of the name), and in place of the text the words that stay, joined by a space."""
    spans = repeats(docs, id_col, text_col, window)
    rows = _rows(docs, id_col, text_col)
    log2 = min(filter_log2(spans.count()), BROADCAST_LOG2)
    words = materialize(words_set(spans.select(F.col("k1").alias("h")), log2), "filter")
    rows = flagged(rows, F.col("k1"), words, log2)
    clear = rows.filter("not maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).drop("maybe")
    met = rows.filter("maybe").drop("maybe").join(spans, ["k1", "k2"], "left")
    both = clear.unionByName(met).select("row", text_of(field(text_col)).cast("binary").alias("text"), "spans")
    done = both.mapInArrow(_without, f"row {docs.schema.simpleString()}, n long, gone long, kept string")
    columns = [F.col("kept").alias(c) if c == text_col else F.col(field(c)) for c in docs.columns]
    n_words, n_removed = free_name(docs.columns, "n_words"), free_name(docs.columns, "n_removed")
    return done.select(*columns, F.col("n").alias(n_words), F.col("gone").alias(n_removed))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS raw FROM documents),
w AS (SELECT doc_id, list_filter(raw, lambda x: x <> '') AS words FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS passage FROM p),
r AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY passage) AS least FROM h) WHERE least < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS k FROM r),
x AS (SELECT doc_id, count(*) AS n_removed, list(k) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: n_removed IS NULL OR NOT list_contains(gone, i)), lambda i: words[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id
"""
