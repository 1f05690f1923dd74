"""SimHash near-dedup with BK-trees.

Each text's 64-bit fingerprint is the majority vote of its shingles' XXH64 values. Fingerprints at ``radius`` or fewer
differing bits link; components of links are the groups.

Two fingerprints within the radius agree on at least one of ``radius + 1`` blocks of bits, so each distinct fingerprint
goes to one shard per block, that of the block's value. The task that gets a shard grows its BK-tree (children keyed
by their integer Hamming distance to the parent) and follows, for all of the shard's fingerprints at once, only
edges whose key is within the radius of the distance to the node. Trees live in their shard's task instead of
being broadcast: all trees together hold every fingerprint of the corpus, which has no size bound. A shard emits a
spanning forest of its links, at most one row per fingerprint, never all pairs; alternating star contraction joins the
shards' forests to components. No fingerprint, link or component reaches the driver.

Defined results: null text is empty; texts without words have fingerprint 0, which links as any other. Rows that
repeat are rows of their own and share a component. Null ids take no part in naming a component: it is named by
the smallest other id, and is null where there is none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import field, freeing, materialize, table, text_of
from cairn.llm.rows import keep_first, keyed, meeting

WORDS, RADIUS, SEED = 4, 4, 42
#: Groups by exact similarity: words a shingle, least Jaccard similarity, bits within which fingerprints are candidates,
#: the number of minima that name a set's shards, and the bins of its sketch.
SET_WORDS, SIMILARITY, SET_RADIUS, MINIMA, BINS = 5, 0.8, 20, 6, 64
#: A shard of more fingerprints, or a candidate group of more shingles, is dealt to several tasks, each of which compares
#: two of its slices.
SHARD_ROWS, GROUP_SHINGLES = 20_000, 3_000_000
#: A subtree of so many fingerprints or fewer is compared at once; the votes of so many shingles are summed at once.
LEAF, VOTES = 48, 1 << 15
_U = np.uint64


def fingerprint(text: str, words: int = WORDS) -> int:
    tokens = text.encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), "i8", len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    for k in range(0, n, VOTES):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + VOTES], stops[k : k + VOTES])), "u8")
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS, out: str = "__fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""

    @freeing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, words) for t in texts), "u8", len(texts)).view("i8"))

    return docs.withColumn(out, F.pandas_udf(run, "long")(text_of(text_col)))


class Forest:
    """Union-find over positions; a root is the smallest position of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while (p != (q := self.parent[p])).any():
            p = q
        self.parent[x] = p
        return p

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.find(members))
        self.parent[roots] = roots[0]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join each of ``a`` with its of ``b``."""
        while (differ := (x := self.find(a)) != (y := self.find(b))).any():
            np.minimum.at(self.parent, np.maximum(x, y)[differ], np.minimum(x, y)[differ])


def bk_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of a shard's distinct fingerprints, the position of the first one linked to it through the shard."""
    forest = Forest(len(fps))
    todo = [(np.arange(len(fps)), np.arange(len(fps)))]
    while todo:
        nodes, queries = todo.pop()  # a subtree's fingerprints, and those that search it
        if len(nodes) <= LEAF:
            for lo in range(0, len(queries), 4096):
                q = queries[lo : lo + 4096]
                near = np.bitwise_count(fps[q][:, None] ^ fps[nodes][None, :]) <= radius
                for k in range(len(nodes)):
                    if (hit := q[near[:, k]]).size > 1 or (hit.size and hit[0] != nodes[k]):
                        forest.join(np.append(hit, nodes[k]))
            continue
        root, rest = nodes[0], nodes[1:]
        to_query = np.bitwise_count(fps[queries] ^ fps[root]).astype("i2")
        forest.join(np.append(queries[to_query <= radius], root))
        key = np.bitwise_count(fps[rest] ^ fps[root]).astype("i2")
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        for k, child in zip(keys.tolist(), np.split(rest[order], first[1:]), strict=True):
            if len(follow := queries[np.abs(to_query - k) <= radius]):
                todo.append((child, follow))
    return forest.find(np.arange(len(fps)))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that cover 64 bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def split_hot(dealt: DataFrame, key: str, limit: int, weight: str | None = None) -> tuple[DataFrame, bool]:
    """``dealt`` (block, value, and ``key``) with ``part``, and whether any shard was cut. A shard of more than ``limit`` rows (or
    sum of ``weight``) is cut into slices by hash of ``key``, and has a part for every two slices, so that any two of its rows
    meet in one and no part is much larger than two slices. Other shards have one part."""
    load = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = materialize(dealt.groupBy("block", "value").agg(load.alias("load")).filter(F.col("load") > limit), "hot")
    if not sizes.head(1):
        return dealt.withColumn("part", F.lit(0).cast("long")), False
    slices = F.ceil(F.col("load") / limit).cast("long")
    own = F.pmod(F.xxhash64(key), slices)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), slices - 1), lambda t: F.least(own, t) * slices + F.greatest(own, t))
    whole = F.array(F.lit(0).cast("long"))
    return dealt.join(sizes, ["block", "value"], "left").withColumn("part", F.explode(F.when(F.col("load").isNull(), whole).otherwise(parts))).drop("load"), True


def _shards(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, the columns' values) of each part of a shard, of rows that come sorted by block, value and part."""
    held, now = [], None
    for batch in batches:
        key = np.stack([batch[c].to_numpy().astype("i8") for c in ("block", "value", "part")])
        rows = np.stack([batch[c].to_numpy().astype("i8") for c in columns])
        new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))) if key.shape[1] else np.zeros(0, bool)
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], key.shape[1]]):
            this = tuple(key[:, lo].tolist())
            if held and this != now:
                yield now[0], np.concatenate(held, 1)
                held = []
            now = this
            held.append(rows[:, lo:hi])
    if held:
        yield now[0], np.concatenate(held, 1)


def shard_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): per shard and fingerprint b that is linked there, the first fingerprint a of its set."""
    shards = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value"))
        for k, (shift, width) in enumerate(_blocks(radius))
    ]
    dealt, _ = split_hot(distinct.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.block", "s.value"), "fp", SHARD_ROWS)
    dealt = dealt.repartition("block", "value", "part").sortWithinPartitions("block", "value", "part", "fp")

    @freeing
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (fps,) in _shards(batches, ["fp"]):
            if len(fps) > 1:
                root = bk_links(fps.view("u8"), radius)
                own = root != np.arange(len(fps))
                if own.any():
                    yield pd.DataFrame({"a": fps[root[own]], "b": fps[own]})

    return dealt.mapInPandas(search, "a long, b long")


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of the component.

    Alternating large-star and small-star steps (connected components in MapReduce), each an aggregation and a join,
    until no edge changes. The aggregates are written before they are joined: both sides of the join are then
    plain shuffles, and adaptive execution can split the partition of a node with very many edges.
    """
    key = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = key(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        low = materialize(both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m")), name)
        large = both.join(low, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        least = materialize(down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), name)
        small = down.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialize(small, name)
        before, state = state, key(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: k1, k2 (its key), doc_id, fp (signed 64 bits), component_id (the smallest doc_id reachable)."""
    rows = keyed(docs, id_col, text_col).select("k1", "k2", F.col(field(id_col)).alias("doc_id"), F.col(field(text_col)).alias("text"))
    lite = materialize(fingerprints(rows, "text", words, "fp").drop("text"), "fingerprints")
    distinct = materialize(lite.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(shard_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "first_id", "root")
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    names = rooted.join(named, "root").select(F.col("fp").alias("named_fp"), "component_id", "root")
    return lite.join(names, F.col("fp") == F.col("named_fp")).drop("named_fp")


def _first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    members = groups.select(F.col("root").alias("g"), "k1", "k2", F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    return keep_first(docs, members, ["no_id", "id"], id_col, text_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group the row of the smallest id, and of
    rows that repeat it one. Only keys are grouped; texts are moved where a key meets a decision."""
    return _first_of_groups(docs, near_groups(docs, id_col, text_col, words, radius), id_col, text_col)


# --- groups by exact similarity --------------------------------------------------------------------------------


def shingle_set(text: str, words: int = SET_WORDS) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; a text of fewer words is one shingle, one without words none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, "u8")
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), "i8", len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "u8", n))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The majority vote of a set's values: each distinct shingle votes once, as in the Jaccard similarity."""
    votes = np.zeros(64, "i8")
    for k in range(0, len(shingles), VOTES):
        votes += np.unpackbits(shingles[k : k + VOTES].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("u8")[0])


def set_key(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], "u8").view("i8")[0])


def minima(shingles: np.ndarray) -> list[int]:
    """MINIMA shingles of a set, each the least by an order of its own: two sets share one of them with the
    probability of their Jaccard similarity."""
    salts = np.random.default_rng(11).integers(0, 1 << 63, (MINIMA, 2), dtype="u8")
    return [int(((shingles ^ x) * (y | _U(1))).min().view("i8")) for x, y in salts] if len(shingles) else []


def sketch(shingles: np.ndarray) -> bytes:
    """A byte for each of BINS equal ranges of hashes: 0 for a range without shingles, else 1 to 255 by its least one."""
    at = np.searchsorted(shingles, np.arange(BINS, dtype="u8") << _U(58))
    out, own = np.zeros(BINS, "u1"), at < np.append(at[1:], len(shingles))
    out[own] = shingles[at[own]] % _U(255) + _U(1)
    return out.tobytes()


def _alike(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches agree as those of similar sets do, four standard deviations allowed."""
    x, y = sketches[a], sketches[b]
    either = np.maximum(((x | y) != 0).sum(1), 1)
    same = ((x == y) & (x != 0)).sum(1)
    return same >= similarity * either - 4 * np.sqrt(similarity * (1 - similarity) * either)


def bk_near(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): positions in a shard of fingerprints within ``radius`` bits of each other, as a search of the shard's BK-tree for all of them
    at once finds them; pairs come both ways, in pieces of bounded size. Subtrees of equal fingerprints are not cut further."""
    todo = [(np.arange(len(fps)), np.arange(len(fps)))] if len(fps) else []
    while todo:
        nodes, queries = todo.pop()  # a subtree's fingerprints, and those that search it
        if len(nodes) <= LEAF or (fps[nodes] == fps[nodes[0]]).all():
            for at in range(0, len(nodes), LEAF):
                some = nodes[at : at + LEAF]
                for lo in range(0, len(queries), 4096):
                    q = queries[lo : lo + 4096]
                    row, col = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[some][None, :]) <= radius)
                    yield some[col], q[row]
            continue
        root, rest = nodes[0], nodes[1:]
        to_query = np.bitwise_count(fps[queries] ^ fps[root]).astype("i2")
        hit = queries[to_query <= radius]
        yield np.full(len(hit), root), hit
        key = np.bitwise_count(fps[rest] ^ fps[root]).astype("i2")
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        for k, child in zip(keys.tolist(), np.split(rest[order], first[1:]), strict=True):
            if len(follow := queries[np.abs(to_query - k) <= radius]):
                todo.append((child, follow))


def near_forest(fps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """For each of one shard's sets, ordered by size: the position of the first set that it hangs together with by candidates, which the
    shard's BK-tree finds. Pairs that hang together already are not looked at again."""
    forest = Forest(len(fps))
    first = np.searchsorted(sizes, np.ceil(similarity * sizes - 1e-9), "left")  # similar sets have similar sizes
    for a, b in bk_near(fps, radius):
        own = (a < b) & (a >= first[b])
        a, b = a[own], b[own]
        open_ = forest.find(a) != forest.find(b)
        a, b = a[open_], b[open_]
        own = _alike(sketches, a, b, similarity)
        forest.link(a[own], b[own])
    return forest.find(np.arange(len(fps)))


def candidate_links(sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): keys of ``sets`` (key, fp, size, minima, sketch) that may be similar. Each set goes to one shard per minimum; a shard
    emits a spanning forest of its candidates, at most one row a set."""
    dealt = sets.select("key", "fp", "size", "sketch", F.posexplode("minima").alias("block", "value"))
    dealt, _ = split_hot(dealt, "key", SHARD_ROWS)
    words = [F.conv(F.hex(F.substring("sketch", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"s{k}") for k in range(BINS // 8)]
    columns = ["key", "fp", "size", *(f"s{k}" for k in range(BINS // 8))]
    dealt = dealt.select("block", "value", "part", "key", "fp", "size", *words)
    dealt = dealt.repartition("block", "value", "part").sortWithinPartitions("block", "value", "part", "size", "fp", "key")

    @freeing
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = [], []
        for _, rows in _shards(batches, columns):
            if rows.shape[1] < 2:
                continue
            key, sketches = rows[0], np.ascontiguousarray(rows[3:].T).view("u1").reshape(-1, BINS)
            root = near_forest(rows[1].view("u8"), rows[2], sketches, radius, similarity)
            own = root != np.arange(len(key))
            left.append(key[root[own]])
            right.append(key[own])
            if len(left) >= 10_000:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
                left, right = [], []
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return dealt.mapInPandas(search, "a long, b long")


def similar_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of one group's sets: the position of the first set that it is linked to, over pairs of at least that Jaccard
    similarity. Sets are compared with all others at once by an inverted index. Once all sets outside one component were
    compared, the sets inside need not be: a link from within leads to a set that was, or stays within."""
    n, lengths = len(sets), np.array([len(x) for x in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), lengths)[np.argsort(inverse, kind="stable")]
    ends = np.cumsum(np.bincount(inverse, minlength=len(values)))
    own = np.split(inverse, np.cumsum(lengths)[:-1])
    forest, seen, hits = Forest(n), np.zeros(n, bool), np.zeros(n, "i8")
    for turn in range(n):
        root = forest.find(np.arange(n))
        largest = np.bincount(root, minlength=n).argmax()
        outside = np.flatnonzero(~seen & (root != largest))
        if turn and not len(outside):
            break
        hub = int(np.where(seen, -1, hits).argmax())  # a set that many others turned out to be similar to
        x = hub if turn % 2 and not seen[hub] and hits[hub] > 1 else int(outside[0]) if len(outside) else 0
        which = own[x]
        start = np.where(which > 0, ends[which - 1], 0)
        each = ends[which] - start
        at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        both = np.bincount(holders[at], minlength=n)
        like = np.flatnonzero(both >= similarity * (lengths + lengths[x] - both) - 1e-9)
        seen[x] = True
        hits[like] += 1
        forest.join(np.append(like, x))
    return forest.find(np.arange(n))


def verified_links(groups: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, bool]:
    """(a, b): each set that is similar to others of its group (key, k1, k2, size, value: the group), and the first set that it is
    linked to in its part; and whether parts have to be joined. ``texts`` (k1, k2, text) has their texts."""
    dealt, cut = split_hot(groups.withColumn("block", F.lit(0)), "key", GROUP_SHINGLES, "size")
    wanted = materialize(dealt.groupBy("key", "k1", "k2").agg(F.collect_list(F.struct("value", "part")).alias("parts")), "wanted")

    @freeing
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "parts": batch["parts"], "shingles": [shingle_set(x, words).tobytes() for x in batch["text"]]})

    held = meeting(texts, wanted).mapInPandas(sets, "key long, parts array<struct<value: long, part: long>>, shingles binary")
    sent = held.select("key", "shingles", F.explode("parts").alias("p")).select("p.value", "p.part", "key", "shingles")
    sent = sent.repartition("value", "part").sortWithinPartitions("value", "part", "key")

    @freeing
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
            once = dict(rows)  # rows that agree in id and text come once each
            keys = np.fromiter(once, "i8", len(once))
            root = similar_forest([np.frombuffer(x, "u8") for x in once.values()], similarity)
            linked = root != np.arange(len(keys))
            return pd.DataFrame({"a": keys[root[linked]], "b": keys[linked]})

        rows, now = [], None
        for batch in batches:
            for value, part, key, shingles in zip(batch["value"], batch["part"], batch["key"], batch["shingles"], strict=True):
                if rows and (value, part) != now:
                    yield out(rows)
                    rows = []
                now = value, part
                rows.append((key, shingles))
        if rows:
            yield out(rows)

    return materialize(sent.mapInPandas(compare, "a long, b long"), "links"), cut


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SET_WORDS, radius: int = SET_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: k1, k2, doc_id, key (of its shingle set), root (the smallest key reachable over pairs of sets
    of at least that Jaccard similarity).

    Sets that share one of their minima meet in a shard, where fingerprints that its BK-tree finds within ``radius`` bits and sketches that
    agree make candidates. Each component of candidates is then one group, to which its sets' shingles travel once, and where exact
    similarities decide. So each step moves a number of rows in proportion to the sets, however large the groups."""

    @freeing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingle_set(t, words)
                rows.append((set_key(s), np.array([set_fingerprint(s)], "u8").view("i8")[0], len(s), minima(s), sketch(s)))
            yield pd.DataFrame(rows, columns=["key", "fp", "size", "minima", "sketch"])

    numbered = keyed(docs, id_col, text_col).select("k1", "k2", F.col(field(id_col)).alias("doc_id"), text_of(field(text_col)).alias("text"))
    marked = numbered.withColumn("s", F.pandas_udf(run, "key long, fp long, size long, minima array<long>, sketch binary")("text"))
    lite = materialize(marked.select("k1", "k2", "doc_id", "s.*"), "fingerprints")
    first = F.min(F.struct("k1", "k2")).alias("first")
    sets = lite.groupBy("key").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("minima").alias("minima"), F.min("sketch").alias("sketch"), first)
    sets = materialize(sets, "distinct")
    candidates = materialize(components(candidate_links(sets, radius, similarity)), "candidates")
    candidates = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    groups = sets.join(candidates, F.col("key") == F.col("node")).select("key", "first.k1", "first.k2", "size", F.col("root").alias("value"))
    links, cut = verified_links(materialize(groups, "groups"), numbered.select("k1", "k2", "text"), words, similarity)
    roots = components(links) if cut else links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return lite.join(roots, F.col("key") == F.col("node"), "left").select("k1", "k2", "doc_id", "key", F.coalesce("root", "key").alias("root"))


def drop_similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SET_WORDS, radius: int = SET_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """As drop_near_copies, for the groups of similar_groups."""
    return _first_of_groups(docs, similar_groups(docs, id_col, text_col, words, radius, similarity), id_col, text_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
