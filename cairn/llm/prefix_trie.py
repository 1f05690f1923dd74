"""Conversation prefix trie: every distinct sequence of first turns is a node.

A turn is known by 16 bytes of the SHA-256 of its role and text, a conversation by the string of its turns' bytes. These strings are
sorted globally by range, so that the members of a node lie together. Each range is swept once with a stack: neighbours'
longest common prefix (LCP) tells which nodes end between them, and a node that ends hands its sums to its parent. Nodes on the path
of a range's first or last conversation may go on in the range before or behind; they are left open. The open stacks, one row per range, are
stitched in order by the LCP of the conversations at the border. A node's digest of ids is taken where its range is swept; for open nodes
ids travel packed by thousands, and one task streams over them in order, as SHA-256 must be fed.

Memory: a task holds one range, which is cut by (turns, conv_id) and so is bounded however often one conversation repeats. A conversation is
one row of 28 bytes a turn; its texts never meet in one place. The stitching task reads one row per range.

Defined results: turns are ordered by turn (null first), then by the digest of role and text. Null role or text is empty. Rows without a
conv_id take no part. Repeated rows are turns of their own. A conversation without turns ends at the root. An empty table has no nodes. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import freeing, materialize, table

#: Bytes of a turn; turns of a range; ids that travel in one piece.
BYTES, TURNS_A_RANGE, IDS_A_PIECE = 16, 100_000, 4096

_SUMS = "least long, n long, children long, leaves long, saved long, chars long"
_OPEN = pa.struct([(x.split()[0], pa.int64()) for x in _SUMS.split(", ")])
_NODE = [(c, pa.int64()) for c in ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")]
#: kind: node, hung (a node whose parent is open), ids (of an open node), stack (what a range leaves open).
_SWEPT = pa.schema([
    ("kind", pa.string()), *_NODE, ("ends_sha256", pa.string()), ("pid", pa.int64()), ("side", pa.int64()), ("piece", pa.int64()), ("ids", pa.string()),
    ("first", pa.binary()), ("last", pa.binary()), ("left", pa.list_(_OPEN)), ("right", pa.list_(_OPEN)),
])
_SWEPT_SQL = (
    "kind string, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pid long, side long, "
    f"piece long, ids string, first binary, last binary, left array<struct<{_SUMS.replace(' ', ':').replace(',:', ', ')}>>, right array<struct<{_SUMS.replace(' ', ':').replace(',:', ', ')}>>"
)
_STITCHED = pa.schema([("kind", pa.string()), *_NODE, ("pid", pa.int64()), ("side", pa.int64())])
_STITCHED_SQL = "kind string, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, pid long, side long"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, and its turns in order as structs (turn, key, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * BYTES)
    each = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.length(text).alias("chars")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that both begin with."""
    n = min(len(a), len(b)) // BYTES
    if a[: n * BYTES] == b[: n * BYTES]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * BYTES] == b[: mid * BYTES] else (low, mid - 1)
    return low


class _Node:
    __slots__ = ("least", "n", "children", "leaves", "saved", "chars", "ends", "below", "first", "parts")

    def __init__(self, chars: int, first: bool = False):
        self.least, self.n, self.children, self.leaves, self.saved, self.chars = None, 0, 0, 0, 0, chars
        self.ends, self.below, self.first, self.parts = [], [], first, []

    def see(self, least: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def take(self, child: _Node) -> None:
        """Add the sums of a child that has ended."""
        self.see(child.least)
        self.n += child.n
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def end(self) -> None:
        """Nothing more comes: own sums join those of the subtree."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars

    def open_sums(self) -> dict:
        return {"least": self.least, "n": self.n, "children": self.children, "leaves": self.leaves, "saved": self.saved, "chars": self.chars}


def _row(node: _Node, depth: int) -> dict:
    return {"conv_id": node.least, "depth": depth, "parent": None, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}


def sweep(rows: Iterator[tuple[int, bytes, list[int]]], pid: int) -> Iterator[dict]:
    """Rows of _SWEPT for one range of (conv_id, turns, code points of the turns) in order."""
    out, stack, left, begin, last = [], [], [], None, None

    def flush(node: _Node, depth: int, side: int) -> None:
        for k in node.below:
            out[k] |= {"kind": "hung", "pid": pid, "side": side}
        for k in range(0, len(node.ends), IDS_A_PIECE):
            out.append({"kind": "ids", "pid": pid, "side": side, "depth": depth, "piece": k, "ids": ",".join(map(str, node.ends[k : k + IDS_A_PIECE]))})

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        if node.first:
            left.append(node)
            return
        node.end()
        for k in node.below:
            out[k]["parent"] = node.least
        stack[-1].below.append(len(out))
        out.append({"kind": "node", **_row(node, depth), "ends_sha256": hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()})
        stack[-1].take(node)

    for conv, key, chars in rows:
        if last is None:
            begin, keep = key, 0
            stack.append(_Node(0, True))
        else:
            keep = shared_turns(last, key)
        while len(stack) > keep + 1:
            pop()
        for k in range(len(stack) - 1, len(key) // BYTES):
            stack.append(_Node(chars[k], last is None))
        top = stack[-1]
        top.ends.append(conv)
        top.n += 1
        top.see(conv)
        last = key
    if last is None:
        return
    both = sum(node.first for node in stack)  # open on either side
    left = stack[:both] + left[::-1]
    for depth, node in enumerate(left):
        flush(node, depth, 0)
    for depth, node in enumerate(stack[both:], both):
        flush(node, depth, 1)
    yield from out
    yield {"kind": "stack", "pid": pid, "first": begin, "last": last, "left": [x.open_sums() for x in left], "right": [x.open_sums() for x in stack[both:]]}


def stitch(ranges: Iterator[tuple[int, bytes, bytes, list[dict], list[dict]]]) -> Iterator[dict]:
    """Rows of _STITCHED from what the ranges left open, in order: each open node, and where its parts lie."""
    stack, last, waiting = [], b"", {}

    def pop() -> Iterator[dict]:
        node, depth = stack.pop(), len(stack)
        node.end()
        yield from ({"kind": "part", "pid": p, "side": s, "depth": depth, "conv_id": node.least} for p, s in node.parts)
        for row in node.below:
            yield row | {"parent": node.least}
        row = {"kind": "node", **_row(node, depth)}
        if stack:
            stack[-1].take(node)
            stack[-1].below.append(row)
        else:
            yield row

    def put(part: dict, pid: int, side: int, depth: int) -> None:
        if depth == len(stack):
            stack.append(_Node(part["chars"]))
        node = stack[depth]
        node.see(part["least"])
        node.n, node.children = node.n + part["n"], node.children + part["children"]
        node.leaves, node.saved = node.leaves + part["leaves"], node.saved + part["saved"]
        node.parts.append((pid, side))

    for pid, begin, end, left, right in ranges:
        keep = shared_turns(last, begin) if stack else 0
        while len(stack) > keep + 1:
            yield from pop()
        for depth, part in enumerate(left):
            put(part, pid, 0, depth)
        both = len(end) // BYTES + 1 - len(right)
        while len(stack) > both:
            yield from pop()
        for depth, part in enumerate(right, both):
            put(part, pid, 1, depth)
        last = end
    while stack:
        yield from pop()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


@freeing
def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(b["conv_id"].to_pylist(), b["keys"].to_pylist(), b["chars"].to_pylist(), strict=True))
    yield from _batches(sweep(rows, TaskContext.get().partitionId()), _SWEPT)


@freeing
def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (tuple(r.values()) for b in batches for r in b.select(["pid", "first", "last", "left", "right"]).to_pylist())
    yield from _batches(stitch(rows), _STITCHED)


@freeing
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])

    def rows() -> Iterator[dict]:
        now = sha = None
        for b in batches:
            for conv, depth, ids in zip(b["conv_id"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if now != (conv, depth):
                    if now:
                        yield {"conv_id": now[0], "depth": now[1], "ends": sha.hexdigest()}
                    now, sha = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if now:
            yield {"conv_id": now[0], "depth": now[1], "ends": sha.hexdigest()}

    yield from _batches(rows(), schema)


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, each once; turns, as ``conversations`` gives them): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    flat = materialize(rebuilt.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars")), "turns")
    n_turns = flat.agg(F.sum(F.size("chars"))).first()[0] or 0
    cores = flat.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-n_turns // TURNS_A_RANGE), min(cores, n_turns // 1000))
    dealt = flat.repartitionByRange(ranges, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    swept = materialize(dealt.mapInArrow(_swept, _SWEPT_SQL), "swept")
    stacks = swept.filter("kind = 'stack'").select("pid", "first", "last", "left", "right")
    stitched = materialize(stacks.repartition(1).sortWithinPartitions("pid").mapInArrow(_stitched, _STITCHED_SQL), "stitched")
    parts = stitched.filter("kind = 'part'").select("pid", "side", "depth", F.col("conv_id").alias("open_conv"))
    pieces = swept.filter("kind = 'ids'").select("pid", "side", "depth", "piece", "ids").join(parts, ["pid", "side", "depth"])
    pieces = pieces.select(F.col("open_conv").alias("conv_id"), "depth", "pid", "piece", "ids").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "pid", "piece")
    ends = pieces.mapInArrow(_digests, "conv_id long, depth long, ends string")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    closed = swept.filter("kind = 'node'").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *sums, "ends_sha256")
    hung = swept.filter("kind = 'hung'").withColumn("above", F.col("depth") - 1).join(parts.withColumnRenamed("depth", "above"), ["pid", "side", "above"])
    hung = hung.select("conv_id", "depth", F.col("open_conv").alias("parent_conv_id"), *sums, "ends_sha256")
    opened = stitched.filter("kind = 'node'").join(ends, ["conv_id", "depth"], "left")
    opened = opened.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *sums, F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    return closed.unionByName(hung).unionByName(opened)


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation c with its first turns from conversation c - c % 100: h = crc32(c as text) % 6 of them, then its own behind its first h."""
    own = materialize(conversations(turns.select("conv_id", "turn", "role", "text")), "conversations")
    donor = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("from"), F.col("turns").alias("given"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    met = own.withColumn("h", h).withColumn("from", F.col("conv_id") - F.col("conv_id") % 100).join(donor, "from", "left")
    given = F.coalesce(F.slice("given", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return met.select("conv_id", F.concat(given, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


#: A turn is known by a digest as in ``conversations``, a prefix by the string of its turns' digests.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS key
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key, chars) AS keys, list(chars ORDER BY turn NULLS FIRST, key, chars) AS chars FROM t GROUP BY conv_id),
c AS (
  SELECT *, conv_id - conv_id % 100 AS donor,
         xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
             lambda i: [ascii((conv_id::VARCHAR)[i:i])::UBIGINT, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 1000]))),
             lambda a, b: CASE WHEN b < 1000 THEN xor(a, b::UBIGINT) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END),
             4294967295::UBIGINT) % 6 AS h
  FROM o),
r AS (
  SELECT c.conv_id, list_concat(coalesce(d.keys[1:c.h], []), c.keys[c.h + 1:]) AS keys, list_concat(coalesce(d.chars[1:c.h], []), c.chars[c.h + 1:]) AS chars
  FROM c LEFT JOIN o d ON d.conv_id = c.donor),
p AS (SELECT conv_id, len(keys) AS size, unnest(range(0, len(keys) + 1)) AS depth, keys, chars FROM r),
m AS (SELECT conv_id, size, depth, array_to_string(keys[1:depth], '') AS path, array_to_string(keys[1:depth - 1], '') AS above,
             CASE WHEN depth = 0 THEN 0 ELSE chars[depth] END AS last_chars FROM p),
n AS (
  SELECT path, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(last_chars) AS last_chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM m GROUP BY path, depth),
k AS (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.path AND k.depth = n.depth),
u AS (SELECT path, depth, unnest(range(0, depth + 1)) AS up, n_children, (n_convs - 1) * last_chars AS saved FROM x),
s AS (SELECT path[1:32 * up] AS path, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
SELECT x.conv_id, x.depth, a.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.path = x.path AND s.depth = x.depth LEFT JOIN n a ON x.depth > 0 AND a.path = x.above AND a.depth = x.depth - 1
"""
