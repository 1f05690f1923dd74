"""LM scoring: a causal self-attention model, trained here in numpy on subword ids, beside a unigram base.

Words (lower-cased A-Z, cut at white space) become ids of a public byte-level BPE vocabulary, each word encoded once
for the whole corpus; an end id closes every text. The model predicts the next id by an adaptive softmax (the most frequent
ids and one entry for each tail first; within a tail, its ids; the rarest ids share the last tail, within which corpus counts decide), attending to the ids before it in
windows of ``CONTEXT + STRIDE`` positions. Windows overlap by ``CONTEXT``, so that each id is scored exactly once and sees
at least CONTEXT ids before it (fewer only at a text's start); windows are scored in batches with a causal mask.

Counts (of words for the base; of ids for ranks and the last tail's inside) cover all training documents. The attention
weights are fitted by distributed training on every training document: a first, short round on one window in FIRST_SHARE
brings all tasks to common weights, then each task passes over all windows of its partition, and the tasks' weights
are averaged by their numbers of ids. Weights travel as one packed vector a task, summed in two steps. A text's score is that of a mixture of
the model and the base, whose shares the training documents tell (``mixed``).

Documents travel as blocks: one written table holds each block's ids of documents, its texts as positions in the list of its
distinct words, and that list with counts, by bucket. Buckets sum the counts and encode each distinct word once; their answers
return to the blocks, which are written again as token ids with all that counts say. Training and scoring read that table.

Defined results: null text is empty and consists of the end token. A null id counts as the empty text. Rows that
repeat are counted and scored each for itself. Without training documents N and V are 0 and the base is log10 of
0.1 / 0.1 a token, that is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import encoder
from cairn.llm.common import freeing, id_crc_mod, materialize, quoted, table, text_of
from cairn.llm.word_shuffle import blocks, buckets, compress, expand, lay_out, list_words, pack_rows, pack_words, shares, unpack_rows, unpack_words

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Positions before a window's scored ones, and scored positions a window; numbers of a position's vectors.
CONTEXT, STRIDE, DIM = 8, 24, 32
#: Ids with vectors of their own; ids in the softmax's head, and in its tails of modelled ids.
INPUTS, HEAD, TAILS = 1024, 64, (128, 320, 512)
#: Windows a step; step size; and the first round's share of windows (one in so many).
BATCH, RATE, FIRST_SHARE = 128, 0.03, 16
BLOCK_CHARS = 5_000_000
#: Logits are held below this, so that no maximum need be taken off before exp.
HIGHEST = np.float32(60)
PAD, BOS = 0, 1
_LEN = CONTEXT + STRIDE


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


# --- the model -------------------------------------------------------------------------------------------------


#: First ranks of the tails and of the rest; the head's width: its ids, the tails and the rest.
_EDGES = [HEAD + sum(TAILS[:k]) for k in range(len(TAILS) + 1)]
REST, WIDTH = _EDGES[-1], HEAD + len(TAILS) + 1


class Ids:
    """What the corpus counts say of ids: input row, rank (REST for all of the last tail), and log10 probability
    within that tail. The last id is the end."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.row = np.full(n, INPUTS - 1, "i4")
        top = order[: INPUTS - 3]
        self.row[top] = np.arange(2, 2 + len(top))
        self.rank = np.full(n, REST, "i4")
        self.rank[order[:REST]] = np.arange(min(REST, n))
        smooth = counts + 0.1
        self.inside = np.zeros(n, "f4")
        rest = order[REST:]
        self.inside[rest] = np.log10(smooth[rest] / smooth[rest].sum())
        by_rank = smooth[order[:REST]]
        parts = [by_rank[a:b] for a, b in zip(_EDGES, _EDGES[1:])]
        head = np.array([*by_rank[:HEAD], *(p.sum() for p in parts), smooth[rest].sum()])
        self.bias = [np.log(x / x.sum()).astype("f4") for x in (head, *parts)]


#: Where an id's row has its key with the key's bias, its value, query and own vector.
_ROW = {"k": slice(0, DIM + 1), "v": slice(DIM + 1, 2 * DIM + 1), "q": slice(2 * DIM + 1, 3 * DIM + 1), "o": slice(3 * DIM + 1, 4 * DIM + 1)}


def shapes() -> dict[str, tuple[int, ...]]:
    out = {"ids": (INPUTS, 4 * DIM + 1), "r": (_LEN,)}
    return out | {f"w{k}": (DIM + 1, n) for k, n in enumerate((WIDTH, *TAILS))}  # the last row is the bias


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out | {name: out["ids"][:, own] for name, own in _ROW.items()}


def start_weights(bias: list[np.ndarray]) -> np.ndarray:
    rng = np.random.default_rng(7)
    flat = np.empty(sum(int(np.prod(s)) for s in shapes().values()), "f4")
    p = unpack(flat)
    for name in ("q", "k", "v", "o", *list(shapes())[1:]):
        p[name][:] = rng.normal(0, 0.1, p[name].shape)
    p["k"][:, DIM], p["r"][:] = 0, 0
    for k, b in enumerate(bias):
        p[f"w{k}"][DIM] = b
    return flat


_QUERY, _KEY = np.arange(STRIDE)[:, None] + CONTEXT, np.arange(_LEN)[None, :]
_DISTANCE = np.clip(_QUERY - _KEY, 0, None)
_CAUSAL = np.where(_KEY <= _QUERY, 0, -1e9).astype("f4")
#: Of each rank, its softmax (0 for the head; the rest has none of its own) and its place in the head's.
_TIER = np.repeat(np.arange(len(TAILS) + 2, dtype="i1"), [HEAD, *TAILS, 1])
_IN_HEAD = np.where(_TIER == 0, np.arange(REST + 1), HEAD - 1 + _TIER)
#: Ids that a batch has more often than this are summed each for itself.
_FEW = 48
#: Rows of a product of matrices that are multiplied at a time: by this many numbers of their product, small products being the faster ones.
_NUMBERS = 20_000


def _exponentials(logits: np.ndarray) -> None:
    """``logits`` become their exponentials, held below a bound that as a rule none comes near."""
    if logits.max(initial=0) > HIGHEST:
        np.minimum(logits, HIGHEST, out=logits)
    np.exp(logits, out=logits)


def _beside(table: np.ndarray, value: float) -> np.ndarray:
    """The table with one more column of ``value``: a product with it gives sums or adds a bias on the way."""
    out = np.full((len(table), table.shape[1] + 1), value, table.dtype)
    out[:, :-1] = table
    return out


def _tables(p: dict) -> tuple[np.ndarray, ...]:
    """Queries, keys, values and own vectors by id as attention multiplies them: a key's last number is its bias, a value's is one, so
    that weights times values end in the weights' sum. Padding is never looked at."""
    keys = p["k"].copy()
    keys[PAD, DIM] = -1e9
    return _beside(p["q"], 1), keys, _beside(p["v"], 1), _beside(p["o"], 0)


def _scatter(n: int, ids: np.ndarray, grads: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows of ``grads`` by id (in ``out``, if given, which is zero): frequent ids each for itself, the others together, first rows, then second rows and so on."""
    out = np.zeros((n, grads.shape[-1]), grads.dtype) if out is None else out
    ids, grads = ids.ravel(), grads.reshape(-1, grads.shape[-1])
    order = np.argsort(ids.astype("i2"), kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    times, rows = np.diff(first, append=len(ids)), ids[order[first]]
    ones = np.ones(int(times.max(initial=0)), grads.dtype)
    for k in np.flatnonzero(times > _FEW).tolist():
        np.dot(ones[: times[k]], grads.take(order[first[k] : first[k] + times[k]], 0), out=out[rows[k]])
    few = np.flatnonzero(times <= _FEW)
    few = few[np.argsort(-times[few], kind="stable")]
    at, more = first[few], len(few) - np.cumsum(np.bincount(times[few], minlength=1))  # more[k]: ids with more than k rows
    total = grads.take(order[at], 0)
    for k, m in enumerate(more[1:-1].tolist(), 1):
        total[:m] += grads.take(order[at[:m] + k], 0)
    out[rows[few]] = total
    return out


def _tiers(ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
    """(softmax number, positions that it takes part in, their targets there); ranks are not negative. None: all positions."""
    yield 0, None, _IN_HEAD.take(ranks)
    tier = _TIER.take(ranks)
    for k, a in enumerate(_EDGES[:-1], 1):
        own = np.flatnonzero(tier == k)
        if len(own):
            yield k, own, ranks.take(own) - a


def _turned(x: np.ndarray) -> np.ndarray:
    """Each window's matrix transposed, as a copy: products with it are that much faster."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _cut(n: int, width: int) -> tuple[int, int]:
    """Rows at a time, and how many of n rows are multiplied so; the others follow by themselves."""
    size = min(max(1, _NUMBERS // width), max(1, n))
    return size, n - n % size


def _product(x: np.ndarray, w: np.ndarray, width: int, out: np.ndarray | None = None) -> np.ndarray:
    """x @ w, by some rows of x at a time; ``width``: the wider of what comes in and goes out."""
    size, n = _cut(len(x), width)
    out = np.empty((len(x), w.shape[1]), x.dtype) if out is None else out
    np.matmul(x[:n].reshape(-1, size, x.shape[1]), w, out=out[:n].reshape(-1, size, w.shape[1]))
    if n < len(x):
        np.matmul(x[n:], w, out=out[n:])
    return out


def _sums(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x.T @ d, in the same way."""
    size, n = _cut(len(x), d.shape[1])
    out = np.matmul(x[:n].reshape(-1, size, x.shape[1]).transpose(0, 2, 1), d[:n].reshape(-1, size, d.shape[1])).sum(0)
    if n < len(x):
        out += x[n:].T @ d[n:]
    return out


def gradient(p: dict, windows: np.ndarray, targets: np.ndarray, told: bool = True) -> tuple[float, np.ndarray]:
    """Mean loss (nats; 0 unless ``told``) and its gradient; targets are ranks, and those below 0 do not count. Exponentials are never
    divided by their sums: what they are multiplied by is, which is narrower."""
    q_ids, t = windows[:, CONTEXT:], targets.ravel()
    q_of, k_of, v_of, o_of = _tables(p)
    q, k, v = q_of.take(q_ids, 0), k_of.take(windows, 0), v_of.take(windows, 0)
    a = q @ _turned(k)
    a += p["r"][_DISTANCE] + _CAUSAL
    _exponentials(a)
    mean = a @ v
    scale = 1 / (mean[:, :, DIM:] + np.float32(1e-30))
    mean *= scale
    h = (mean + o_of.take(q_ids, 0)).reshape(-1, DIM + 1)  # its last column is one, for the bias
    use = t >= 0
    shares, loss = (use / np.float32(max(1, int(use.sum())))).astype(h.dtype), 0.0
    flat = np.zeros(sum(p[name].size for name in shapes()), h.dtype)
    g = unpack(flat)
    for tier, own, goal in _tiers(np.maximum(t, 0)):
        w = p[f"w{tier}"]
        x, share = (h, shares) if own is None else (h.take(own, 0), shares.take(own))
        width = w.shape[1]
        d, wanted = _product(x, w, width), np.arange(0, len(goal) * width, width) + goal
        numbers = d.reshape(-1)
        right = np.minimum(numbers.take(wanted), HIGHEST) if told else 0
        _exponentials(d)
        total = d @ np.ones(width, d.dtype)
        if told:
            loss += float((np.log(total) - right) @ share)
        numbers[wanted] -= total
        part = (share / total)[:, None]
        g[f"w{tier}"][:] = _sums(x * part, d)
        dx = _product(d, np.ascontiguousarray(w[:DIM].T), width)
        dx *= part
        if own is None:
            dh = dx
        else:
            dh[own] += dx
    dh, inner = dh.reshape(*mean.shape[:2], DIM), np.empty_like(mean)
    # by position: what its k, bias of k, v, and (of scored positions) q and o are to move by
    at = np.empty((*windows.shape, 4 * DIM + 1), dh.dtype)
    at[:, :CONTEXT, 2 * DIM + 1 :] = 0
    at[:, CONTEXT:, _ROW["o"]] = dh
    inner[:, :, DIM] = -np.einsum("bij,bij->bi", dh, mean[:, :, :DIM])
    inner[:, :, :DIM] = dh
    inner *= scale
    ds = inner @ _turned(v)
    ds *= a
    np.matmul(ds.transpose(0, 2, 1), q, out=at[:, :, _ROW["k"]])
    np.matmul(a.transpose(0, 2, 1), inner[:, :, :DIM], out=at[:, :, _ROW["v"]])
    np.matmul(ds, k[:, :, :DIM], out=at[:, CONTEXT:, _ROW["q"]])
    _scatter(INPUTS, windows, at, g["ids"])
    g["r"][:] = np.bincount(_DISTANCE.ravel(), (ds.sum(0) * (_CAUSAL == 0)).ravel(), _LEN)
    return loss, flat


def layout(ids: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (ids, and each text's length): input rows with room before each text, the windows'
    starts there, and each id's place among the windows' scored positions."""
    windows = -(-lengths // STRIDE)
    room = windows * STRIDE + CONTEXT
    first = np.cumsum(room) - room
    within = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.full(int(room.sum()), PAD, "i4")
    place = np.repeat(first + CONTEXT, lengths) + within
    later = within < np.repeat(lengths - 1, lengths)
    flat[place[later] + 1] = row[ids[later]]
    flat[first + CONTEXT] = BOS
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(first, windows) + number * STRIDE
    scored = np.repeat((np.cumsum(windows) - windows) * STRIDE, lengths) + within
    return flat, starts, scored


class Adam:
    """Steps over windows in random order, each block once at any size; the step size falls with every block, and within it, so that the average of
    several learners' weights is taken when they move little."""

    def __init__(self, flat: np.ndarray, seed: int):
        self.flat, self.rng, self.step, self.blocks = flat.copy(), np.random.default_rng(seed), 0, 0
        self.m, self.s, self.move = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)

    def learn(self, inputs: np.ndarray, starts: np.ndarray, targets: np.ndarray) -> None:
        order = self.rng.permutation(len(starts))
        steps, span = -(-len(order) // BATCH), np.arange(_LEN)
        self.blocks += 1
        for k in range(steps):
            pick = order[k * BATCH : (k + 1) * BATCH]
            _, g = gradient(unpack(self.flat), inputs.take(starts[pick][:, None] + span), targets[pick], told=False)
            self.step += 1
            rate = RATE / np.sqrt(self.blocks) * (1 - 0.9 * k / steps) * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            self._move(g, np.float32(rate))

    def _move(self, g: np.ndarray, rate: np.float32) -> None:
        """One step, in place; ``g`` is used up. ``m`` is ten times the gradients' mean, ``s`` a hundred times that of their squares."""
        m, s, move = self.m, self.s, self.move
        m *= np.float32(0.9)
        m += g
        g *= g
        s *= np.float32(0.99)
        s += g
        np.sqrt(s, out=move)
        move += np.float32(1e-7)
        np.divide(m, move, out=move)
        move *= rate
        self.flat -= move


def score_ranks(flat: np.ndarray, inputs: np.ndarray, starts: np.ndarray, targets: np.ndarray, size: int = 128) -> np.ndarray:
    """log10 probability of each window position's rank; targets (windows, STRIDE), below 0 for no position. The
    buffers of a batch of ``size`` windows are used again and again; the scores do not depend on it."""
    p, out = unpack(flat), np.empty(targets.shape, "f4")
    # attention mixes rows of v, so these are bounds for any text: as a rule no maximum need be taken off before exp
    scores = p["q"] @ p["k"][:, :DIM].T + p["k"][:, DIM]
    high, low = scores.max() + p["r"].max(), scores.min() + p["r"].min()
    last = [p[f"w{k}"] for k in range(len(TAILS) + 1)]
    for w in last:
        ahead, mixing = p["o"] @ w[:DIM], p["v"] @ w[:DIM]
        high, low = max(high, (ahead.max(0) + mixing.max(0) + w[DIM]).max()), min(low, (ahead.min(0) + mixing.min(0) + w[DIM]).max())
    safe = high < 80 and low > -80
    bias = (p["r"][_DISTANCE] + _CAUSAL).astype("f4")
    queries, keys, values, own_vectors = _tables(p)
    span, n = np.arange(_LEN), size * STRIDE
    weights, mixed = np.empty((size, STRIDE, _LEN), "f4"), np.empty((size, STRIDE, DIM + 1), "f4")
    logits, ones = [np.empty((n, w.shape[1]), "f4") for w in last], [np.ones(w.shape[1], "f4") for w in last]
    for lo in range(0, len(starts), size):
        windows = inputs.take(starts[lo : lo + size][:, None] + span)
        q_ids, t = windows[:, CONTEXT:], np.maximum(targets[lo : lo + size], 0).ravel()
        k = len(windows)
        a = np.matmul(queries.take(q_ids, 0), _turned(keys.take(windows, 0)), out=weights[:k])
        a += bias
        if not safe:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        m = np.matmul(a, values.take(windows, 0), out=mixed[:k])
        m *= 1 / (m[:, :, DIM:] + np.float32(1e-30))
        m += own_vectors.take(q_ids, 0)
        h, found = m.reshape(-1, DIM + 1), np.zeros(len(t), "f4")
        for tier, own, goal in _tiers(t):
            width = len(ones[tier])
            g = _product(h if own is None else h.take(own, 0), last[tier], width, logits[tier][: len(goal)])
            if not safe:
                g -= g.max(1, keepdims=True)
            wanted = g.reshape(-1).take(np.arange(0, len(goal) * width, width) + goal)
            np.exp(g, out=g)
            wanted -= np.log(g @ ones[tier])
            if own is None:
                found += wanted
            else:
                found[own] += wanted
        out[lo : lo + size] = found.reshape(-1, STRIDE) * np.float32(1 / np.log(10))
    return out


# --- the corpus ------------------------------------------------------------------------------------------------


def _ints(values: np.ndarray) -> bytes:
    """Compressed whole numbers, in two bytes each where they fit."""
    small = not len(values) or (values.min() >= 0 and values.max() < 65536)
    return compress(b"2" + values.astype("u2").tobytes() if small else b"4" + values.astype("i4").tobytes())


def _read_ints(packed: bytes) -> np.ndarray:
    raw = expand(packed)
    return np.frombuffer(raw, "u2" if raw[:1] == b"2" else "i4", offset=1).astype("i4")


def _block_table(docs: DataFrame, n: int) -> DataFrame:
    """Written: (block, rows, flat, lengths, deal, n_train): each block's rows without texts, its texts as positions in its list
    of words, their lengths, and each word's bucket; and (block, bucket, words, counts): its distinct words by bucket with
    the number of times that training documents have them."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, "text", BLOCK_CHARS):
            index, flat, lengths = list_words(rows.column("text").to_pylist(), _words)
            held_out = rows.column("held_out").to_numpy()
            counts = np.bincount(flat[np.repeat(~held_out, lengths)], minlength=len(index))
            words, out, deal = list(index), [], np.zeros(len(index), "i4")
            for k, own in shares(words, n) if words else ():
                deal[own] = k
                out.append((k, pack_words([words[i] for i in own.tolist()]), compress(counts[own].astype("i8").tobytes())))
            column = lambda kind, first, rest: pa.array([first, *rest], kind)
            none = [None] * len(out)
            yield pa.record_batch({
                "block": column("int64", block, [block] * len(out)), "bucket": column("int32", None, [k for k, _, _ in out]),
                "rows": column("binary", pack_rows(rows.drop_columns(["text"])), none), "flat": column("binary", _ints(flat), none),
                "lengths": column("binary", _ints(lengths), none), "deal": column("binary", _ints(deal), none),
                "n_train": column("int64", int((~held_out).sum()), [0] * len(out)),
                "words": column("binary", None, [w for _, w, _ in out]), "counts": column("binary", None, [c for _, _, c in out]),
            })

    schema = "block long, bucket int, rows binary, flat binary, lengths binary, deal binary, n_train long, words binary, counts binary"
    return materialize(docs.mapInArrow(run, schema), "blocks", "uncompressed")


def _word_table(table_: DataFrame, path: str, size: int) -> DataFrame:
    """Written, one row per bucket: its distinct words with their counts, lengths and ids; sums; and how often
    training documents have each id."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, now, counts = encoder(path).encode_ordinary, None, {}

        def row() -> pa.RecordBatch:
            words, c = list(counts), np.fromiter(counts.values(), "i8", len(counts))
            ids = [np.array(encode(" " + w.decode()), "i4") for w in words]
            lengths = np.fromiter(map(len, ids), "i4", len(ids))
            flat = np.concatenate(ids)
            own = np.bincount(flat, np.repeat(c, lengths), size).astype("i8")
            some = np.flatnonzero(own)
            return pa.record_batch({
                "bucket": pa.array([now], "int32"), "words": pa.array([pack_words(words)], "binary"), "counts": pa.array([compress(c.tobytes())], "binary"),
                "lengths": pa.array([_ints(lengths)], "binary"), "ids": pa.array([_ints(flat)], "binary"),
                "n": pa.array([int(c.sum())], "int64"), "v": pa.array([int((c > 0).sum())], "int64"),
                "id": pa.array([some.astype("i4")], pa.list_(pa.int32())), "times": pa.array([own[some]], pa.list_(pa.int64())),
            })

        for batch in batches:
            for bucket, words, more in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if bucket != now and counts:
                    yield row()
                    counts = {}
                now = bucket
                get = counts.get
                counts.update({w: get(w, 0) + c for w, c in zip(unpack_words(words), np.frombuffer(expand(more), "i8").tolist(), strict=True)})
        if counts:
            yield row()

    dealt = table_.filter("bucket is not null").select("bucket", "words", "counts").repartition("bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(run, "bucket int, words binary, counts binary, lengths binary, ids binary, n long, v long, id array<int>, times array<long>"), "words", "uncompressed")


def _id_counts(words: DataFrame, size: int) -> np.ndarray:
    """How often training documents have each id: a vocabulary's worth of sums."""
    got = words.select(F.inline(F.arrays_zip("id", "times"))).toDF("id", "n").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, "i8")
    out[got["id"].to_numpy("i8")] = got["n"].to_numpy("i8")
    return out


def _answers(table_: DataFrame, words: DataFrame) -> DataFrame:
    """(to_block, bucket, counts, lengths, ids) of each block's words, in the block's order. A bucket's own row is
    sorted before the blocks' rows, which then stream by."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, lengths, ids = {}, None, None, None
        for batch in batches:
            out = []
            for bucket, block, asked, c, n, x in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "words", "counts", "lengths", "ids")), strict=True):
                if block is None:
                    index = {w: k for k, w in enumerate(unpack_words(asked))}
                    counts, lengths, ids = np.frombuffer(expand(c), "i8"), _read_ints(n), _read_ints(x)
                    continue
                own = np.fromiter(map(index.__getitem__, unpack_words(asked)), "i8")
                laid, each = lay_out(own, lengths, ids)
                out.append((block, bucket, compress(counts[own].tobytes()), _ints(each), _ints(laid)))
            kinds = {"to_block": "int64", "bucket": "int32", "counts": "binary", "lengths": "binary", "ids": "binary"}
            yield pa.record_batch({name: pa.array([o[k] for o in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    none = F.lit(None).cast("binary")
    own = words.select("bucket", F.lit(None).cast("long").alias("block"), "words", "counts", "lengths", "ids")
    asked = table_.filter("bucket is not null").select("bucket", "block", "words", none.alias("counts"), none.alias("lengths"), none.alias("ids"))
    dealt = own.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "to_block long, bucket int, counts binary, lengths binary, ids binary")


def _windows(flat_ids: np.ndarray, n_ids: np.ndarray, row: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """layout's inputs, starts and places, and the windows' targets."""
    inputs, starts, scored = layout(flat_ids, n_ids, row)
    targets = np.full(len(starts) * STRIDE, -1, "i4")
    targets[scored] = rank[flat_ids]
    return inputs, starts, scored, targets.reshape(-1, STRIDE)


def _fit(laid: DataFrame, ids: Ids) -> np.ndarray:
    """Weights, averaged over tasks by their numbers of ids: after a round on a share of the windows, and one on all."""
    spark = laid.sparkSession
    flat = start_weights(ids.bias)
    for share in (FIRST_SHARE, 1):
        shared = spark.sparkContext.broadcast((flat, ids.row, ids.rank))

        @freeing
        def run(batches: Iterator[pa.RecordBatch], shared=shared, share=share) -> Iterator[pa.RecordBatch]:
            flat, row, rank = shared.value
            learner, n = Adam(flat, share), 0
            for batch in batches:
                for packed, lengths, held_out in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_ids", "held_out")), strict=True):
                    n_ids, held = _read_ints(lengths), np.frombuffer(held_out, bool)
                    flat_ids = _read_ints(packed)[np.repeat(~held, n_ids)]
                    if not len(flat_ids):
                        continue
                    inputs, starts, _, targets = _windows(flat_ids, n_ids[~held], row, rank)
                    own = np.arange(0, len(starts), share)
                    learner.learn(inputs, starts[own], targets[own])
                    n += len(flat_ids)
            if n:
                total = (learner.flat.astype("f8") * n).tobytes()
                yield pa.record_batch({"x": pa.array([total], "binary"), "n": pa.array([n], "int64")})

        @freeing
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for x, k in zip(batch.column("x").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    total = np.frombuffer(x, "f8") + (0 if total is None else total)
                    n += k
            if n:
                yield pa.record_batch({"x": pa.array([total.tobytes()], "binary"), "n": pa.array([n], "int64")})

        parts = materialize(laid.select("ids", "n_ids", "held_out").mapInArrow(run, "x binary, n long"), "weights", "uncompressed")
        some = parts.repartition(max(1, int(parts.count() ** 0.5))).mapInArrow(add, "x binary, n long")
        for x, n in some.repartition(1).mapInArrow(add, "x binary, n long").collect():
            flat = (np.frombuffer(x, "f8") / n).astype("f4")
    return flat


def _laid_table(table_: DataFrame, words: DataFrame, size: int, n_docs: int, total: int, distinct: int, kind: str) -> DataFrame:
    """Written, one row per block: (rows, ids, n_ids, held_out): its documents with all that counts say of them, and their texts as
    token ids, each text closed by the end id ``size``."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = dict(zip(right.column("bucket").to_pylist(), zip(*(right.column(k).to_pylist() for k in ("counts", "lengths", "ids")), strict=True), strict=True))
        out = []
        for rows, packed, lengths, deal in zip(*(left.column(c).to_pylist() for c in ("rows", "flat", "lengths", "deal")), strict=True):
            docs_, own_words, n_words, deal = unpack_rows(rows), _read_ints(packed), _read_ints(lengths).astype("i8"), _read_ints(deal)
            end = len(deal)  # the end token's place behind the words
            found = [answered[k] for k in np.unique(deal).tolist()]
            counts = np.concatenate([*(np.frombuffer(expand(c), "i8") for c, _, _ in found), [n_docs]])
            own_lengths = np.concatenate([*(_read_ints(x) for _, x, _ in found), np.ones(1, "i4")])
            own_ids = np.concatenate([*(_read_ints(x) for _, _, x in found), np.array([size], "i4")])
            moved = np.empty(end, "i4")
            moved[np.argsort(deal, kind="stable")] = np.arange(end)
            base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
            n_tokens = n_words + 1
            place_ = np.full(int(n_tokens.sum()), end, "i4")
            inner = np.ones(len(place_), bool)
            inner[np.cumsum(n_tokens) - 1] = False
            place_[inner] = moved[own_words]
            first = np.cumsum(n_tokens) - n_tokens
            flat_ids, each = lay_out(place_, own_lengths, own_ids)
            told = pa.table({
                "doc_id": docs_.column("doc_id"), "held_out": docs_.column("held_out"), "n_tokens": pa.array(n_tokens, "int64"),
                "n_known": pa.array(np.add.reduceat((counts[place_] > 0).astype("i8"), first), "int64"),
                "train_tokens": pa.array(np.full(len(n_tokens), total), "int64"), "base_score": pa.array(np.add.reduceat(base[place_], first)),
            })
            held = docs_.column("held_out").to_numpy().astype(bool)
            out.append((pack_rows(told), _ints(flat_ids), _ints(np.add.reduceat(each, first)), held.tobytes()))
        return pa.table({name: pa.array([r[k] for r in out], "binary") for k, name in enumerate(("rows", "ids", "n_ids", "held_out"))})

    own = table_.filter("bucket is null").select("block", "rows", "flat", "lengths", "deal")
    placed = own.groupBy("block").cogroup(_answers(table_, words).groupBy("to_block")).applyInArrow(place, "rows binary, ids binary, n_ids binary, held_out binary")
    return materialize(placed, "laid", "uncompressed")


def mixed(scored: DataFrame) -> DataFrame:
    """``scored`` (written; held_out, base_score, model_score, ...) with score: the log10 probability that a mixture of the word base and the model gives
    the text. The model's share is that of the training documents that it finds likelier than the base does, so that a text scores below the base by
    no more than the base's share takes off, however little the model has learnt from few documents."""
    better, n = scored.filter("not held_out").agg(F.count_if(F.col("model_score") > F.col("base_score")), F.count(F.lit(1))).first()
    share = (better + 0.5) / (n + 1)
    a, b = F.col("model_score") + math.log10(share), F.col("base_score") + math.log10(1 - share)
    top = F.greatest(a, b)
    return scored.withColumn("score", top + F.log10(F.pow(F.lit(10.0), a - top) + F.pow(F.lit(10.0), b - top)))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, model_score (the attention model's alone), score."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), (id_crc_mod(quoted(id_col), 10) == 0).alias("held_out"), text_of(quoted(text_col)).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    size = encoder(path).max_token_value + 1
    table_ = _block_table(rows, buckets(docs.sparkSession))
    words = _word_table(table_, path, size)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_docs, (n_words, v_words) = table_.agg(zero("n_train")).first()[0], words.agg(zero("n"), zero("v")).first()
    laid = _laid_table(table_, words, size, n_docs, n_words + n_docs, v_words + (n_docs > 0), kind)
    ids = Ids(np.append(_id_counts(words, size), n_docs))
    flat = _fit(laid, ids)
    shared = docs.sparkSession.sparkContext.broadcast((flat, ids.row, ids.rank, ids.inside))

    @freeing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, row, rank, inside = shared.value
        for batch in batches:
            for told, packed, lengths in zip(*(batch.column(c).to_pylist() for c in ("rows", "ids", "n_ids")), strict=True):
                flat_ids, n_ids = _read_ints(packed), _read_ints(lengths)
                inputs, starts, scored, targets = _windows(flat_ids, n_ids, row, rank)
                by_rank = score_ranks(flat, inputs, starts, targets).ravel()[scored]
                total = np.add.reduceat(by_rank.astype("f8") + inside[flat_ids], np.cumsum(n_ids) - n_ids)
                yield from unpack_rows(told).append_column("model_score", pa.array(total)).to_batches()

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, model_score double"
    return mixed(materialize(laid.select("rows", "ids", "n_ids").mapInArrow(score, schema), "scored"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
