"""Media columns: ISO media containers in a binary column.

``pack`` stores bytes losslessly as 8-bit samples in a container (ftyp, mdat, moov); ``probe`` walks nested boxes,
decodes the sample tables (stts, stsc, stsz, stco or co64, stss) and yields codec, duration and the keyframes' byte
ranges without touching a payload; ``read_samples`` follows the same tables to the stored bytes.

Defined results: null or broken media give nulls from ``probe`` and ``samples``, and never fail a task; a box whose size leaves its
parent is broken, as are boxes nested more than MAX_DEPTH deep, tables that are shorter than stated or point outside the
file, samples that no chunk holds, and chunks whose samples are not stated. A column of the result's name is replaced; all
others come back as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.llm.common import freeing, table, text_of

#: Boxes that hold only boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf")
#: Boxes that a box may lie in, one inside the other.
MAX_DEPTH = 32
#: Bytes a sample, samples a second and a chunk, and every which sample is marked as a keyframe.
SAMPLE_BYTES, TIMESCALE, SAMPLES_A_CHUNK, KEY_EVERY = 64, 8000, 256, 16
CODEC = b"raw "

PROBED = T.StructType([
    T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("n_samples", T.LongType()),
    T.StructField("key_ranges", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
])
#: Rows whose media are in a Python worker's hands at once.
SLICE_ROWS = 200


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pack(payload: bytes) -> bytes:
    """A container whose one track holds ``payload`` (a positive multiple of SAMPLE_BYTES) as samples."""
    n = len(payload) // SAMPLE_BYTES
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    large = len(payload) + 16 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(head) + len(mdat)
    full, rest = divmod(n, SAMPLES_A_CHUNK)
    chunks = first + np.arange(full + (rest > 0), dtype="u8") * (SAMPLES_A_CHUNK * SAMPLE_BYTES)
    runs = [(1, SAMPLES_A_CHUNK)] * (full > 0) + [(full + 1, rest)] * (rest > 0)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    wide = large or int(chunks[-1]) >= 1 << 32
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
    )
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
    hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
    mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), bytes(80))
    moov = _box(b"moov", mvhd, _box(b"trak", _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))))
    return b"".join((head, mdat, payload, moov))


def boxes(media: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, parents before children; nested MAX_DEPTH deep at most."""
    todo = [(0, len(media), ())]  # rests of boxes whose children were not read yet, the innermost last
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("bytes left after the last box")
        size, kind = struct.unpack_from(">I4s", media, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("no room for a large size")
            size, head = struct.unpack_from(">Q", media, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"{kind!r} leaves its parent")
        yield (*path, kind), start + head, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes are nested too deeply")
            todo.append((start + head, start + size, (*path, kind)))


def _numbers(media: bytes, start: int, end: int, kind: str, skip: int, width: int = 1) -> np.ndarray:
    """The entries of a full box's table: the count stands ``skip`` bytes after its start."""
    count = struct.unpack_from(">I", media, start + skip)[0]
    if start + skip + 4 + count * width * np.dtype(kind).itemsize > end:
        raise ValueError("a table leaves its box")
    return np.frombuffer(media, kind, count * width, start + skip + 4).astype("i8").reshape(count, width)


def sample_table(media: bytes) -> dict:
    """Codec, time scale, duration, and each sample's offset, size and keyframe mark, of the first track. ValueError of
    whatever is no such file. Stated numbers are compared with the file's length before anything is made of them."""
    out, at = {}, {}
    tracks = 0
    try:
        for path, a, b in boxes(media):
            tracks += path[-1] == b"trak"
            if tracks <= 1 and b"trak" in path:
                at.setdefault(path[-1], (a, b))
        a, b = at[b"mdhd"]
        long = a < b and media[a] == 1
        if b - a < (32 if long else 20):
            raise ValueError("a media header is too short")
        out["timescale"], out["duration"] = struct.unpack_from(">IQ", media, a + 20) if long else struct.unpack_from(">II", media, a + 12)
        a, b = at[b"stsd"]
        if b - a < 16:
            raise ValueError("a sample description is too short")
        out["codec"] = struct.unpack_from(">4s", media, a + 12)[0].decode("latin-1").strip()
        times = _numbers(media, *at[b"stts"], ">u4", 4, 2)
        runs = _numbers(media, *at[b"stsc"], ">u4", 4, 3)
        wide = b"co64" in at
        chunks = _numbers(media, *at[b"co64" if wide else b"stco"], ">u8" if wide else ">u4", 4)[:, 0]
        a, b = at[b"stsz"]
        if b - a < 12:
            raise ValueError("a table of sizes is too short")
        same, count = struct.unpack_from(">II", media, a + 4)
        marked = _numbers(media, *at[b"stss"], ">u4", 4)[:, 0] - 1 if b"stss" in at else None
    except (KeyError, struct.error) as e:
        raise ValueError(f"a box is missing or too short: {e}") from None
    if out["duration"] >= 1 << 63:
        raise ValueError("a duration that no clock reaches")
    if same * count > len(media):
        raise ValueError("samples leave the file")
    if len(chunks) and (chunks.min() < 0 or chunks.max() > len(media)):
        raise ValueError("chunks leave the file")
    sizes = np.full(count, same, "i8") if same else _numbers(media, a, b, ">u4", 8)[:, 0]
    if times[:, 0].sum() != count or (len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks))):
        raise ValueError("time or chunk tables do not fit the samples")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, "i8")
    if len(per) != len(chunks) or per.sum() != count:
        raise ValueError("chunks do not hold the samples stated")
    chunk_of = np.repeat(np.arange(len(chunks)), per)
    before = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    offsets = chunks[chunk_of] + before[:-1] - before[first][chunk_of]
    if count and (offsets + sizes).max() > len(media):
        raise ValueError("samples leave the file")
    keys = np.ones(count, bool)
    if marked is not None:
        if len(marked) and (marked.min() < 0 or marked.max() >= count):
            raise ValueError("a keyframe is no sample")
        keys = np.zeros(count, bool)
        keys[marked] = True
    ticks = sum(int(n) * int(t) for n, t in times.tolist())
    return out | {"offsets": offsets, "sizes": sizes, "keys": keys, "ticks": ticks}


def read_samples(media: bytes) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one range."""
    t = sample_table(media)
    start, end = t["offsets"], t["offsets"] + t["sizes"]
    if not len(start):
        return b""
    new = np.concatenate(([True], start[1:] != end[:-1]))
    last = np.concatenate((new[1:], [True]))
    return b"".join(media[a:b] for a, b in zip(start[new].tolist(), end[last].tolist(), strict=True))


def _appended(df: DataFrame, source: str, name: str, kind: T.DataType, value) -> DataFrame:
    """``df`` with ``name``: value of each of ``source``'s bytes (null of null), computed few rows at a time."""
    columns = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(name, kind)])
    arrow = to_arrow_schema(T.StructType([T.StructField(name, kind)]))

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(lo, SLICE_ROWS)
                made = [None if x is None else value(x) for x in rows.column(source).to_pylist()]
                yield rows.select(columns).append_column(name, pa.array(made, arrow.field(0).type))

    return df.mapInArrow(run, schema)


def _probe(media: bytes) -> dict | None:
    try:
        t = sample_table(media)
    except ValueError:
        return None
    k = t["keys"]
    ranges = [{"start": a, "length": b} for a, b in zip(t["offsets"][k].tolist(), t["sizes"][k].tolist(), strict=True)]
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(k), "key_ranges": ranges}


def padded(text: Column) -> Column:
    """UTF-8 of a text with bytes 0 up to a positive multiple of SAMPLE_BYTES."""
    raw = text.cast("binary")
    n = F.octet_length(raw)
    to = F.greatest(F.lit(SAMPLE_BYTES), (F.ceil(n / SAMPLE_BYTES) * SAMPLE_BYTES).cast("int"))
    return F.concat(raw, F.substring(F.lit(bytes(SAMPLE_BYTES)), F.lit(1), to - n))


def pack_column(df: DataFrame, payload: str, media: str) -> DataFrame:
    return _appended(df, payload, media, T.BinaryType(), pack)


def probe_column(df: DataFrame, media: str, probed: str) -> DataFrame:
    return _appended(df, media, probed, PROBED, _probe)


def _samples(media: bytes) -> bytes | None:
    try:
        return read_samples(media)
    except ValueError:
        return None


def samples_column(df: DataFrame, media: str, payload: str) -> DataFrame:
    return _appended(df, media, payload, T.BinaryType(), _samples)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_of()
    stored = pack_column(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), padded(text).alias("__payload")), "__payload", "__media")
    read = samples_column(probe_column(stored.drop("__payload"), "__media", "__probe"), "__media", "__read")
    ranges = F.array_join(F.transform("__probe.key_ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["length"].cast("string"))), ",")
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("__read").cast("long").alias("payload_bytes"),
        F.sha2("__read", 256).alias("payload_sha256"),
        F.crc32(F.substring("__read", -SAMPLE_BYTES, SAMPLE_BYTES)).alias("tail_crc32"),
        F.octet_length("__media").cast("long").alias("media_bytes"),
        F.sha2("__media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("codec="), F.col("__probe.codec")),
                    F.concat(F.lit("seconds="), (F.col("__probe.duration") / F.col("__probe.timescale")).cast("string")),
                    F.concat(F.lit("samples="), F.col("__probe.n_samples").cast("string")),
                    F.concat(F.lit("keyframes="), F.size("__probe.key_ranges").cast("string")),
                    F.concat(F.lit("key_ranges_sha256="), F.sha2(ranges.cast("binary"), 256))).alias("feature"),
        F.col("__probe.key_ranges").alias("key_ranges"),
    )
