"""A global shuffle of distinct words, packed: blocks of documents send their distinct words to buckets by hash, and
get back what the bucket's task knows of each word.

A block lists its words in the order of first appearance. Each bucket gets a block's share of them as one compressed
row, and answers in the same order, so that answers need no words. A row a word would cost a hundred times as many rows.
"""

from __future__ import annotations

import io
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import SparkSession

#: Never part of UTF-8, so it separates words.
SEPARATOR = b"\xff"
#: Buckets for each shuffle partition: several, so that hashing deals them evenly.
BUCKETS_A_PARTITION = 4


def buckets(spark: SparkSession) -> int:
    return BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def compress(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack_words(words: list[bytes]) -> bytes:
    return compress(SEPARATOR.join(words))


def unpack_words(packed: bytes) -> list[bytes]:
    return expand(packed).split(SEPARATOR)


def shares(words: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its words in the block's list), for buckets that have any."""
    own = np.fromiter(map(zlib.crc32, words), "u4", len(words)) % np.uint32(n)
    order = np.argsort(own, kind="stable")
    found, first = np.unique(own[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """(block number, rows): runs of this partition's rows with ``limit`` bytes of text, or a row more."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        start = 0
        for k, length in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            size += length
            if size >= limit:
                held.append(batch.slice(start, k + 1 - start))
                yield number, pa.Table.from_batches(held)
                held, size, number, start = [], 0, number + 1, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield number, pa.Table.from_batches(held)


def pack_rows(rows: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_table(rows)
    return sink.getvalue()


def unpack_rows(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def list_words(texts: list, split: Callable[[str], list[bytes]]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The words of a block's texts in the order of first appearance, with their positions there; each text's words
    as such positions, end to end; and the texts' numbers of words."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__  # a new word gets the next position
    flat = []
    for text in texts:
        words = split(text or "")
        flat.append(np.fromiter(map(index.__getitem__, words), "i4", len(words)))
    index.default_factory = None
    return index, np.concatenate(flat) if flat else np.zeros(0, "i4"), np.fromiter(map(len, flat), "i8", len(flat))


def lay_out(which: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of ragged entries, laid out in the order of ``which``; and each laid entry's length."""
    first = np.cumsum(lengths, dtype="i8") - lengths
    own = lengths[which].astype("i8")
    shift = first[which] - (np.cumsum(own) - own)
    return values[np.repeat(shift, own) + np.arange(int(own.sum()))], own
