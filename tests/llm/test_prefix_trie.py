"""The prefix trie against one worked out with dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cairn.llm import prefix_trie

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """Nodes of {conv_id: tuple of turns (key, chars)}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaf = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * p[-1][1] for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(60))
def test_sweep_and_stitch(seed):
    """Ranges cut anywhere, also within a run of equal conversations."""
    rnd = random.Random(seed)
    alphabet = [(bytes([k]) * prefix_trie.BYTES, k) for k in range(1, 3 + seed % 3)]
    convs = {c: tuple(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 3, 6]))) for c in rnd.sample(range(1000), rnd.randint(1, 30))}
    if seed % 4 == 0:
        convs |= {2000 + k: tuple(alphabet) for k in range(15)}
    rows = sorted((b"".join(k for k, _ in t), c, [n for _, n in t]) for c, t in convs.items())
    cuts = sorted(rnd.sample(range(len(rows) + 1), min(len(rows), rnd.randint(0, 6))))
    old, prefix_trie.IDS_A_PIECE = prefix_trie.IDS_A_PIECE, 4
    try:
        swept = [r for pid, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])) for r in prefix_trie.sweep(((c, k, n) for k, c, n in rows[a:b]), pid)]
    finally:
        prefix_trie.IDS_A_PIECE = old
    stacks = [(r["pid"], r["first"], r["last"], r["left"], r["right"]) for r in swept if r["kind"] == "stack"]
    stitched = list(prefix_trie.stitch(iter(stacks)))
    parts = {(r["pid"], r["side"], r["depth"]): r["conv_id"] for r in stitched if r["kind"] == "part"}
    ids = defaultdict(list)
    for r in sorted((r for r in swept if r["kind"] == "ids"), key=lambda r: (r["pid"], r["piece"])):
        ids[parts[r["pid"], r["side"], r["depth"]], r["depth"]].append(r["ids"])
    names = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    got = []
    for r in swept:
        if r["kind"] in ("node", "hung"):
            parent = r["parent"] if r["kind"] == "node" else parts[r["pid"], r["side"], r["depth"] - 1]
            got.append((r["conv_id"], r["depth"], parent, *(r[n] for n in names), r["ends_sha256"]))
    for r in stitched:
        if r["kind"] == "node":
            ends = hashlib.sha256(",".join(ids[r["conv_id"], r["depth"]]).encode()).hexdigest()
            got.append((r["conv_id"], r["depth"], r["parent"], *(r[n] for n in names), ends))
    assert sorted(got, key=str) == brute(convs)


SCHEMA = "conv_id long, turn long, role string, text string, keys int, pid int, depth string"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            role, text = r or "", x or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: prefix_trie.BYTES]
            turns[c].append((t is not None, t or 0, key, len(text)))
    own = {c: tuple((k, n) for *_, k, n in sorted(v)) for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, ())[: h[c]] + t[h[c] :] for c, t in own.items()}


def test_against_brute_force(spark):
    """Nulls, ties, repeated rows, long and empty texts, negative ids apart: none are in the contract."""
    rnd, rows = random.Random(3), []
    for c in [*range(0, 40), *range(100, 160), 205, 399]:
        for k in range(rnd.randint(1, 7)):
            rows.append((c, rnd.choice([None, k, k]), rnd.choice(["user", "assistant", None, ""]), rnd.choice([None, "", "hi", "hi", "é" * 9, "x" * 70000]), 1, 2, "d"))
    rows += rows[:5] + [(None, 1, "user", "lost", 0, 0, None)]
    rows += [(c, k, "user", "the same", 0, 0, None) for c in range(1000, 1060) for k in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    old, prefix_trie.TURNS_A_RANGE = prefix_trie.TURNS_A_RANGE, 40
    try:
        got = prefix_trie.trie(prefix_trie.rebuilt_conversations(frame)).select(*FIELDS).collect()
    finally:
        prefix_trie.TURNS_A_RANGE = old
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))


def test_turnless_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.rebuilt_conversations(none)).count() == 0
    # conversation 5's first turns come from conversation 0, which is absent
    rows = [(5, 0, "user", "a", 0, 0, None)]
    got = prefix_trie.trie(prefix_trie.rebuilt_conversations(spark.createDataFrame(rows, SCHEMA))).select(*FIELDS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))
