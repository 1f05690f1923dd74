"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into words at single spaces that stand between two other characters that are no white space; the
pre-token pattern never matches across such a cut, and the space goes to the word behind it. Pass one sends each block
of documents' distinct words to buckets by hash; a bucket's task pre-tokenises and encodes each distinct word once and
answers every block that has it. Pass two packs each block's rows (compressed) and meets the answers: words are laid
out again by their positions and replaced by their ids.

A block is a run of rows of one input partition. Answers carry a checksum of the words asked for; if a plan deals rows
differently in the two passes, words without an answer are encoded in place, so the ids are right in any case. A bucket
whose words outgrow ``MAX_KNOWN`` starts its list anew; a task keeps one bucket's list at a time. Decoding looks up each id's bytes in the vocabulary's table.

Defined results: null text is empty and has no ids. Rows that repeat are encoded alike, each for itself. An
empty table gives an empty result. The columns asked for come back, with ``ids`` under a name of the caller's choice.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.llm.common import free_name, freeing, quoted, table
from cairn.llm.word_shuffle import blocks, buckets, compress, expand, lay_out, list_words, pack_rows, pack_words, shares, unpack_rows, unpack_words

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text after which a block of documents ends.
BLOCK_CHARS = 4_000_000
#: Distinct words that a bucket remembers.
MAX_KNOWN = 2_000_000
#: Rows that are decoded at once.
DECODED_ROWS = 500

_WIDE = re.compile(r"\s\s|^\s|\s$")
#: White space that the pre-token pattern knows and Python's \s does not, or the other way round, is left to it.
_ODD = regex.compile(r"[\x1c-\x1f\x85]")


@functools.lru_cache(4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"ranks of {path}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    with open(path, "rb") as f:
        ranks = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * (max(ranks, default=(-1, b""))[0] + 1)
    for rank, raw in ranks:
        out[rank] = raw
    return out


def words_of(text: str) -> list[bytes]:
    """Pieces whose concatenation is the text and that pre-tokenise each for itself."""
    if not text:
        return []
    if _WIDE.search(text) or _ODD.search(text):
        return [w.encode() for w in _careful(text)]
    first, *rest = text.encode().split(b" ")
    return [first, *[b" " + w for w in rest]]


def _careful(text: str) -> list[str]:
    """Cuts only before a space that has other than white space on both sides."""
    out, start = [], 0
    for m in regex.finditer(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])", text):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def _asked(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(bucket, block, words): each block's distinct words, by bucket."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, text, BLOCK_CHARS):
            index: dict[bytes, None] = {}
            for t in rows.column(text).to_pylist():
                index.update(dict.fromkeys(words_of(t or "")))
            words = list(index)
            out = [(k, pack_words([words[i] for i in own.tolist()])) for k, own in shares(words, n)]
            yield pa.record_batch({"bucket": pa.array([k for k, _ in out], "int32"), "block": pa.array([block] * len(out), "int64"), "words": pa.array([w for _, w in out], "binary")})

    return docs.select(text).mapInArrow(run, "bucket int, block long, words binary")


def _answered(asked: DataFrame, path: str) -> DataFrame:
    """(to_block, bucket, check, ids): numbers of ids and the ids of the words asked for, in that order."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, now = encoder(path).encode_ordinary, {}, None
        for batch in batches:
            checks, ids = [], []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = unpack_words(packed)
                if bucket != now or len(known) > MAX_KNOWN:  # buckets have no word in common
                    known.clear()
                now = bucket
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w.decode()), "u4").tobytes()
                own = list(map(known.__getitem__, words))
                lengths = np.fromiter(map(len, own), "u4", len(own)) // np.uint32(4)
                # low and high halves apart: the high ones are zeros, or nearly so
                flat = np.frombuffer(b"".join(own), "u2").reshape(-1, 2)
                checks.append(zlib.crc32(b"".join(words)))
                ids.append(compress(np.uint32(len(own)).tobytes() + lengths.tobytes() + flat[:, 0].tobytes() + flat[:, 1].tobytes()))
            yield pa.record_batch({"to_block": batch.column("block"), "bucket": batch.column("bucket"), "check": pa.array(checks, "int64"), "ids": pa.array(ids, "binary")})

    return asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "to_block long, bucket int, check long, ids binary")


def _unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(expand(packed), "u2")
    n = int(raw[:2].view("u4")[0])
    lengths, halves = raw[2 : 2 + 2 * n].view("u4"), raw[2 + 2 * n :]
    low, high = np.split(halves, 2)
    return lengths, low.astype("i4") | high.astype("i4") << 16


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """(block, rows): each block's rows as one compressed Arrow stream."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, text, BLOCK_CHARS):
            yield pa.record_batch({"block": pa.array([block], "int64"), "rows": pa.array([pack_rows(rows)], "binary")})

    return docs.mapInArrow(run, "block long, rows binary")


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, unless given) with an array of token ids per row; a column of that name is replaced."""
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    text = text_col if text_col in keep else free_name(keep, "__text")
    prepared = docs.select(*map(quoted, keep), *[F.col(quoted(text_col)).cast("string").alias(text)] * (text_col not in keep))
    n = buckets(docs.sparkSession)
    answers = _answered(_asked(prepared, text, n), path)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    empty = to_arrow_schema(schema)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = {k: (c, x) for k, c, x in zip(right.column("bucket").to_pylist(), right.column("check").to_pylist(), right.column("ids").to_pylist(), strict=True)}
        parts = []
        for packed in left.column("rows"):
            rows = unpack_rows(packed.as_buffer())
            index, flat, lengths = list_words(rows.column(text).to_pylist(), words_of)
            words = list(index)
            counts, ids, order = [], [], []
            for k, own in shares(words, n) if words else ():
                check, found = answered.get(k, (None, b""))
                asked = [words[i] for i in own.tolist()]
                if check == zlib.crc32(b"".join(asked)):
                    c, x = _unpack_ids(found)
                else:  # this pass dealt the rows in other blocks
                    each = [encoder(path).encode_ordinary(w.decode()) for w in asked]
                    c, x = np.array([len(e) for e in each], "u4"), np.array([i for e in each for i in e], "i4")
                order.append(own)
                counts.append(c)
                ids.append(x)
            if words:
                place_ = np.empty(len(words), "i8")
                place_[np.concatenate(order)] = np.arange(len(words))
                laid, own = lay_out(place_[flat], np.concatenate(counts), np.concatenate(ids))
                ends = np.concatenate(([0], np.cumsum(own)))[np.concatenate(([0], np.cumsum(lengths)))]
            else:
                laid, ends = np.zeros(0, "i4"), np.zeros(len(lengths) + 1, "i8")
            array = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(laid.astype("i4")))
            parts.append(rows.select(keep).append_column(ids_col, array))
        return pa.concat_tables(parts).cast(empty) if parts else empty.empty_table()

    return _packed(prepared, text).groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(place, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that the ids stand for behind the other columns, as ``out`` (with underscores behind it where the
    caller has a column of the name)."""
    path, out = path or public_tokenizers.path(VOCABULARY), free_name(encoded.columns, out)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = token_bytes(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                rows = batch.slice(lo, DECODED_ROWS)
                raw = []
                for ids in rows.column(ids_col):
                    own = ids.values
                    raw.append(b"" if own is None else b"".join(map(table_.__getitem__, own.to_numpy().tolist())))
                yield rows.append_column(out, pa.array(raw, "binary"))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def digests(encoded: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows, which are decoded here as decode_documents does, a few at a
    time, so that neither the decoded bytes nor the ids as text leave the worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema[id_col].dataType

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(path)
        shown = [str(k).encode() for k in range(len(raw))]
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                rows = batch.slice(lo, DECODED_ROWS)
                counts, ids_sha, decoded_sha = [], [], []
                for ids in rows.column(1):
                    own = [] if ids.values is None else ids.values.to_numpy().tolist()
                    counts.append(len(own))
                    ids_sha.append(hashlib.sha256(b" ".join(map(shown.__getitem__, own))).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join(map(raw.__getitem__, own))).hexdigest())
                yield pa.record_batch({"doc_id": rows.column(0), "n_tokens": pa.array(counts, "int64"), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(decoded_sha)})

    text = T.StringType()
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", text), T.StructField("decoded_sha256", text)])
    return encoded.select(F.col(quoted(id_col)), F.col(quoted(ids_col))).mapInArrow(run, schema)
