"""WARC archives and their index, merged externally.

``write_archives`` turns captures into WARC records (one gzip member each) with revisit records for payloads seen
before; an archive is a row of bytes in a written table, so any store that Spark writes to can hold it and a lost
task's output is never half there. ``read_archives`` parses the records back. ``capture_runs`` sorts each archive's
captures locally by URL key and timestamp; ``merge_runs`` cuts all runs at common splits of the full sort key and merges
the k pieces of a range with a loser tree, which gives globally ordered capture histories. The splits come from a
bounded sample of keys; as they cut by URL key, timestamp and id, one hot URL is cut as well.

Defined results: null html is an empty payload; null urls have the empty key and sort first. Payloads below
``MIN_BYTES`` never refer to others. Of equal payloads, rows with the smallest page_id are responses (rows that repeat it, too); the rest
revisit it; a null page_id sorts last, and is the response only where all ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import freeing, materialize, table
from cairn.llm.rows import BROADCAST_LOG2, filter_log2, flagged, words_set

MIN_BYTES = 100
#: Compressed bytes after which an archive ends; captures a merge range holds about; keys sampled for each range, and
#: at most: ranges grow beyond 40,000 captures only where there are more than some 16 thousand million.
ARCHIVE_BYTES, RANGE_ROWS, KEYS_A_RANGE, SAMPLE_KEYS = 4_000_000, 40_000, 20, 400_000

CAPTURE = "page_id long, urlkey string, ts string, record_type string, payload_bytes long, payload_digest string, refers_to long, target string, offset long, length long"


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, then ``)`` and path and query, without scheme, user, ``www.``, port
    of the scheme and fragment; lower case."""
    m = re.match(r"(?:([a-z][a-z0-9+.-]*)://)?([^/?#]*)([^#]*)", url.strip().lower(), re.S)
    scheme, host, rest = m[1] or "http", m[2].rpartition("@")[2], m[3]
    host = re.sub({"http": r":80$", "https": r":443$"}.get(scheme, r":$"), "", host)
    host = re.sub(r"^www\d*\.", "", host).strip(".")
    return ",".join(reversed(host.split("."))) + ")" + (rest if rest.startswith("/") else "/" + rest)


def _record(kind: str, page_id, url: str, ts: str, digest: str, n: int, payload: bytes, refers_to=None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: " + f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z",
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def _raw(html: str = "html"):
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def first_captures(pages: DataFrame) -> DataFrame:
    """Written: (page_id, payload_digest, refers_to) of the rows that revisit an earlier capture. Only ids, lengths and digests shuffle."""
    sums = pages.select("page_id", F.octet_length(_raw()).alias("n"), F.sha2(_raw(), 256).alias("digest"))
    sums = materialize(sums, "digests").filter(F.col("n") >= MIN_BYTES)
    firsts = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    decided = sums.join(materialize(firsts, "firsts"), "digest").filter(later & F.col("refers_to").isNotNull())
    return materialize(decided.select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame) -> DataFrame:
    """A written table of archives (archive long, content binary) with one record per row of ``pages`` (page_id,
    url, html, ts; other columns are not read). Rows that a filter of the revisits clears are written where they lie; only the
    others meet the decisions."""
    decided = first_captures(pages)
    key = F.xxhash64(F.col("page_id").isNull(), "page_id", "digest")
    log2 = min(filter_log2(decided.count()), BROADCAST_LOG2)
    words = materialize(words_set(decided.select(key.alias("h")), log2), "filter")
    own = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), "ts")
    own = flagged(own.withColumn("digest", F.sha2(_raw(), 256)), key, words, log2)
    told = decided.select(F.col("page_id").alias("told_page"), F.col("digest").alias("told_digest"), "refers_to")
    met = own.filter("maybe").join(told, F.col("page_id").eqNullSafe(F.col("told_page")) & (F.col("digest") == F.col("told_digest")), "left")
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # as text: nulls would make floats of numbers
    alone = own.filter("not maybe").withColumn("refers_to", F.lit(None))
    rows = alone.select("url", "html", "ts", "digest", *ids).unionByName(met.select("url", "html", "ts", "digest", *ids))

    @freeing
    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for page, url, html, ts, digest, to in zip(b["page_id"], b["url"], b["html"], b["ts"], b["digest"], b["refers_to"], strict=True):
                raw = html.encode()
                record = _record("response", page, url, ts, digest, len(raw), raw) if to is None else _record("revisit", page, url, ts, digest, len(raw), b"", to)
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"content": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"content": [b"".join(held)]})

    written = materialize(rows.mapInPandas(archive, "content binary"), "archives", "uncompressed")
    return written.select(F.monotonically_increasing_id().alias("archive"), "content")


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(content):
        z, out, start = zlib.decompressobj(31), [], at
        while not z.eof:
            piece = view[at : at + 65536]
            if not piece:
                raise ValueError("a record is cut off")
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield start, at - start, b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit")
    return fields, rest[:n]


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def captures(content: bytes) -> list[tuple]:
    """The archive's captures (fields of CAPTURE), read back and checked."""
    out = []
    for offset, length, raw in members(content):
        f, payload = parse_record(raw)
        kind, url = f["WARC-Type"], f.get("WARC-Target-URI", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        digest, n = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
        if kind == "response":
            n, found = len(payload), hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"record at {offset} does not fit its digest")
        ts = re.sub(r"\D", "", f["WARC-Date"])
        out.append((_page(f["WARC-Record-ID"]), url_key(url) if url else "", ts, kind, n, digest, _page(f.get("WARC-Refers-To", "")), url, offset, length))
    return out


_FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]


def sort_key(c: tuple) -> tuple:
    return c[1], c[2], c[0] is None, c[0] or 0


def capture_runs(archives: DataFrame) -> DataFrame:
    """(archive, pos, fields of CAPTURE): one run per archive, sorted by URL key, timestamp and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["archive"], b["content"], strict=True):
                rows = sorted(captures(content), key=sort_key)
                frame = pd.DataFrame(rows, columns=_FIELDS).astype({"page_id": "Int64", "refers_to": "Int64"})
                frame.insert(0, "pos", np.arange(len(frame)))
                frame.insert(0, "archive", name)
                yield frame

    return materialize(archives.mapInPandas(run, f"archive long, pos long, {CAPTURE}"), "runs")


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(r) for r in range(self.k)]
        self.tree = [-1] * self.k
        for r in range(self.k):
            self._play(r)

    def _head(self, r: int):
        return (0, self.key(self.runs[r][self.at[r]]), r) if self.at[r] < len(self.runs[r]) else (1, (), r)

    def _play(self, r: int) -> None:
        node = (r + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = r
                return
            if self.heads[other] < self.heads[r]:
                self.tree[node], r = r, other
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]][0] == 0:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            self._play(w)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Fields of CAPTURE, archive, and (range, pos): the place in the global order by URL key, timestamp and id."""
    n = runs.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    step = max(1, n // min(SAMPLE_KEYS, KEYS_A_RANGE * ranges))
    sample = runs.filter((F.col("pos") + F.xxhash64("archive") % step) % step == 0) if step > 1 else runs
    keys = sorted(sort_key((r[0], r[1], r[2])) for r in sample.select("page_id", "urlkey", "ts").limit(2 * SAMPLE_KEYS).collect())
    splits = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    shared = runs.sparkSession.sparkContext.broadcast(splits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["page_id"]
            found = [bisect.bisect_right(shared.value, (k, t, i is pd.NA or i != i, 0 if i is pd.NA or i != i else int(i))) for k, t, i in zip(b["urlkey"], b["ts"], ids, strict=True)]
            b.insert(0, "range", found)
            yield b

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["archive", "pos"], kind="stable").astype({"page_id": "Int64", "refers_to": "Int64"})
        names = [*_FIELDS, "archive"]
        plain = group[names].astype(object).where(group[names].notna(), None)
        pieces = [list(p.itertuples(index=False, name=None)) for _, p in plain.groupby("archive", sort=True)]
        out = pd.DataFrame(list(LoserTree(pieces, sort_key)), columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        out.insert(0, "pos", np.arange(len(out)))
        out.insert(0, "range", key[0])
        return out

    # ids beyond 2**53 would lose digits as floats beside nulls, so nullable ids travel as text
    ids = ("page_id", "refers_to")
    fields = CAPTURE.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")

    def cut_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in cut(x.assign(page_id=pd.array([None if i is None else int(i) for i in x["page_id"]], dtype="Int64")) for x in batches):
            yield b.assign(page_id=b["page_id"].astype("string").astype(object).where(b["page_id"].notna(), None))

    def merge_text(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = {c: pd.array([None if i is None else int(i) for i in group[c]], dtype="Int64") for c in ids}
        return merge(key, group.assign(**whole))

    dealt = runs.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(cut_text, f"range int, archive long, pos long, {fields}")
    return dealt.groupBy("range").applyInPandas(merge_text, f"range int, pos long, {CAPTURE}, archive long")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # the table has no capture times: the id counts seconds from a fixed day
    seconds = F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) % 100_000_000
    pages = pages.withColumn("ts", F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss"))
    merged = merge_runs(capture_runs(write_archives(pages)))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", F.col("ts").alias("capture_ts"), "range", "pos")
