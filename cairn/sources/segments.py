"""The index of a workspace, kept up to date by batches of changed files: a log of segments.

Each batch writes one segment with the files it changed and what follows from them: symbols, chunks, vectors, postings and references, every row with its
path and the batch's number. What the batch supersedes is named by tombstones (path, seq), which are small; rows that are already written are
not touched. Readers take the rows of all segments but those that a tombstone names: tombstones are broadcast, so that no content is shuffled
to find the newest. They are bounded: beyond MAX_TOMBS the segments are merged. What BM25 needs of the whole is kept by sums: documents and tokens, document
frequencies, and how many terms have which frequency, from which the mean idf follows.

Segments have levels: FANOUT segments of one level become one of the next, without the rows that are dead by then, so that a row is written again
some log(batches) times. The manifest says which segments count; a batch is there once its manifest is, and a batch that comes again is passed
over. Files of merged segments stay for readers that have begun, until ``vacuum``.

Import edges depend on which files are there, so their targets are resolved when edges are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import detect_language, is_test_file
from cairn.operators import search
from cairn.operators.graph import build_edges
from cairn.operators.parse import chunk_file
from cairn.operators.workspace import read_files, references_of, symbols_of
from cairn.sources.scratch import file_system, materialize
from cairn.sources.tables import feature_hash_embedding

FANOUT, MAX_TOMBS, FILE_ROWS = 4, 1_000_000, 2_000_000

CHANGES = "path string, ord long, action string, content string, new_path string"
STORES = {
    "files": "path string, language string, content string",
    "symbols": "path string, ord int, name string, symbol_type string, start_line int, end_line int",
    "chunks": "path string, id string, symbol_name string, chunk_type string, content string, start_line int, end_line int",
    "vectors": "path string, id string, embedding array<float>",
    "postings": "path string, id string, term string, tf long, dl int",
    "refs": "path string, ord int, kind string, target string, line int",
}
SUMS = {"terms": "term string, df long", "spread": "df long, terms long", "totals": "n long, tokens long"}


# --- manifest ---------------------------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, where = file_system(spark, f"{root}/manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest state: version, last batch, segments (name, level, first and last batch), folders of tombstones with their rows."""
    found = _manifests(spark, root)
    if not found:
        return {"version": 0, "last": -1, "segments": [], "tombs": {}}
    fs, where = file_system(spark, f"{root}/manifest/{found[-1]}")
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, state: dict) -> dict:
    """Write ``state`` as the next version; a version that another writer has written meanwhile is an error."""
    state = state | {"version": state["version"] + 1}
    fs, made = file_system(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if not fs.rename(made, file_system(spark, f"{root}/manifest/{state['version']}")[1]):
        fs.delete(made, False)
        raise RuntimeError(f"version {state['version']} of {root} is there already")
    return state


# --- reading ----------------------------------------------------------------------------------------------------------


def _read(spark: SparkSession, root: str, names: list[str], store: str) -> DataFrame:
    schema = f"{STORES[store]}, seq long" if store in STORES else SUMS[store]
    paths = [f"{root}/segments/{n}/{store}" for n in names]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _tombs(spark: SparkSession, root: str, state: dict) -> DataFrame:
    paths = [f"{root}/tombs/{n}" for n in state["tombs"]]
    return spark.read.schema("path string, seq long").parquet(*paths) if paths else spark.createDataFrame([], "path string, seq long")


def _alive(rows: DataFrame, tombs: DataFrame, state: dict) -> DataFrame:
    if not state["tombs"]:
        return rows
    return rows.join(F.broadcast(tombs) if sum(state["tombs"].values()) <= MAX_TOMBS else tombs, ["path", "seq"], "left_anti")


def live(spark: SparkSession, root: str, store: str, state: dict | None = None) -> DataFrame:
    """The rows of a store that no later batch has superseded, with the batch (seq) that wrote them."""
    state = state or manifest(spark, root)
    rows = _read(spark, root, [s["name"] for s in state["segments"]], store)
    return _alive(rows, _tombs(spark, root, state), state).select(*[c.split()[0] for c in STORES[store].split(", ")], "seq")


def sums(spark: SparkSession, root: str, store: str, state: dict | None = None) -> DataFrame:
    state = state or manifest(spark, root)
    return _added(_read(spark, root, [s["name"] for s in state["segments"]], store), store)


def _added(rows: DataFrame, store: str) -> DataFrame:
    if store == "totals":
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tokens")])
    key, count = [c.split()[0] for c in SUMS[store].split(", ")]
    return rows.groupBy(key).agg(F.sum(count).alias(count)).filter(F.col(count) != 0)


def edges(spark: SparkSession, root: str) -> DataFrame:
    """The graph's edges, as ``build_edges`` gives them, of the files that are there."""
    state = manifest(spark, root)
    files = live(spark, root, "files", state).select(F.col("path").alias("file_path"))
    return build_edges(live(spark, root, "refs", state), live(spark, root, "symbols", state), files)


def bm25_topk(spark: SparkSession, root: str, query: list[str], k: int) -> DataFrame:
    """(id, path, score) of the k best chunks that have a term of the query. Terms reach the files as a filter; they are sorted by term."""
    state = manifest(spark, root)
    hits = live(spark, root, "postings", state).filter(F.col("term").isin(*sorted(set(query))))
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    total = sums(spark, root, "totals", state).first()
    spread = sums(spark, root, "spread", state).agg(F.sum(F.col("terms") * search.idf_of(F.col("df"), F.lit(total.n))).alias("idf"), F.sum("terms").alias("terms")).first()
    weight = search.term_weights(query, df, total.n, 0.25 * spread.idf / spread.terms if spread.terms else 0.0)
    of = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term")) if weight else F.lit(0.0)
    part = of * search._impact(F.col("tf"), F.col("dl"), F.lit(total.tokens / total.n if total.n else 1.0))
    return hits.groupBy("id", "path").agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 9)), "id", "path").limit(k)


# --- writing ----------------------------------------------------------------------------------------------------------


def build(files: DataFrame) -> dict[str, DataFrame]:
    """All stores of files (path, language, content), each parsed once. Tests have no postings."""
    read = materialize(read_files(files), "read")
    symbols = materialize(symbols_of(files, read), "symbols")
    chunks = materialize(chunk_file(files, symbols), "chunks")
    terms = search.postings(chunks.filter(~is_test_file(F.col("path"))).select(F.struct("path", "id").alias("key"), "content"), "key", "content")
    return {
        "files": files, "symbols": symbols, "chunks": chunks, "refs": references_of(read), "vectors": chunks.select("path", "id", feature_hash_embedding(F.col("content")).alias("embedding")),
        "postings": terms.select("id.path", F.col("id.id").alias("id"), "term", "tf", "dl"),
    }


def _write(rows: DataFrame, root: str, name: str, store: str) -> None:
    """Postings and frequencies lie sorted by term, in files of bounded size; the rest as it comes."""
    key = {"postings": ["term", "path", "id"], "terms": ["term"], "files": ["path"]}.get(store)
    if key:
        rows = materialize(rows, store)
        files = max(1, -(-rows.count() // FILE_ROWS))
        rows = rows.repartitionByRange(files, *key).sortWithinPartitions(*key)
    rows.select(*[c.split()[0] for c in (STORES[store] + ", seq long" if store in STORES else SUMS[store]).split(", ")]).write.mode("overwrite").parquet(f"{root}/segments/{name}/{store}")


def resolve(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content), one row for each path that the changes touch: its content afterwards, null where the file is gone. Changes are taken in the order
    of ord. A renamed file takes what its old path held at that moment, be it from ``files`` or from a change before; where there was nothing, nothing comes.
    Renames wait for renames before them, so that a chain takes as many rounds as it has links."""
    inside = changes.filter(~F.startswith("path", F.lit("/")) & ~F.startswith("path", F.lit("..")))
    moved = inside.filter("action = 'renamed' and new_path <> path")
    content = F.when(F.col("action") == "modified", F.coalesce("content", F.lit("")))
    known = materialize(inside.filter("action <> 'renamed' or new_path <> path").select("path", "ord", content.alias("content")), "events")
    waiting = materialize(moved.select("path", "new_path", "ord"), "moves")
    while waiting.count():
        ask = waiting.select("path", "new_path", "ord")
        before = ask.join(known.select("path", F.col("ord").alias("o"), "content"), "path").filter("o < ord").groupBy("path", "new_path", "ord").agg(F.max("o").alias("seen"), F.max_by(F.struct("content"), "o").alias("held"))
        coming = ask.join(waiting.select(F.col("new_path").alias("path"), F.col("ord").alias("o")), "path").filter("o < ord").groupBy("path", "new_path", "ord").agg(F.max("o").alias("later"))
        both = ask.join(before, ["path", "new_path", "ord"], "left").join(coming, ["path", "new_path", "ord"], "left")
        both = materialize(both.withColumn("ready", F.col("later").isNull() | F.coalesce(F.col("seen") > F.col("later"), F.lit(False))), "ready")
        old = both.filter("ready and seen is null").join(files.select("path", F.col("content").alias("there")), "path").select("new_path", "ord", F.col("there").alias("content"))
        new = both.filter("ready and seen is not null").select("new_path", "ord", F.col("held.content").alias("content")).unionByName(old).filter("content is not null")
        known = materialize(known.unionByName(new.withColumnRenamed("new_path", "path")), "events")
        waiting = materialize(both.filter("not ready").select("path", "new_path", "ord"), "moves")
    return known.groupBy("path").agg(F.max_by(F.struct("content"), F.struct("ord", F.col("content").isNotNull())).alias("r")).select("path", "r.content")


def apply_batch(spark: SparkSession, root: str, changes: DataFrame, seq: int) -> dict:
    """Bring the changes (rows of CHANGES; action modified, deleted or renamed) of batch ``seq`` into the index. A batch that is there is passed over."""
    state = manifest(spark, root)
    if seq <= state["last"]:
        return state
    name, held = f"{seq}-{uuid.uuid4().hex[:8]}", live(spark, root, "files", state)
    after = materialize(resolve(materialize(changes.select(*[c.split()[0] for c in CHANGES.split(", ")]), "changes"), held), "after")
    dead = held.select("path", "seq").join(after.select("path"), "path", "left_semi")
    dead.write.mode("overwrite").parquet(f"{root}/tombs/{name}")
    dead = spark.read.schema("path string, seq long").parquet(f"{root}/tombs/{name}")
    gone = dead.count()
    files = after.filter("content is not null").withColumn("language", detect_language(F.col("path"))).filter("language <> 'unknown'")
    for store, rows in build(materialize(files.select("path", "language", "content"), "files")).items():
        _write(rows.withColumn("seq", F.lit(seq).cast("long")), root, name, store)
    new = _read(spark, root, [name], "postings")
    old = live(spark, root, "postings", state).join(F.broadcast(dead) if gone <= MAX_TOMBS else dead, ["path", "seq"], "left_semi")
    moved = materialize(new.select("path", "id", "term", "dl", F.lit(1).alias("way")).unionByName(old.select("path", "id", "term", "dl", F.lit(-1).alias("way"))), "moved")
    terms = materialize(moved.groupBy("term").agg(F.sum("way").cast("long").alias("df")).filter("df <> 0"), "terms")
    _write(terms, root, name, "terms")
    each = moved.groupBy("path", "id", "way").agg(F.max("dl").alias("dl"))
    _write(each.agg(F.coalesce(F.sum("way"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("way") * F.col("dl")), F.lit(0)).cast("long").alias("tokens")), root, name, "totals")
    was = sums(spark, root, "terms", state).join(terms.select("term"), "term", "left_semi").select("term", F.col("df").alias("was"))
    steps = terms.join(was, "term", "left").select(F.coalesce("was", F.lit(0)).alias("was"), "df")
    steps = steps.select(F.explode(F.array(F.struct(F.col("was").alias("df"), F.lit(-1).alias("by")), F.struct((F.col("was") + F.col("df")).alias("df"), F.lit(1).alias("by")))).alias("s"))
    _write(steps.select("s.df", "s.by").filter("df > 0").groupBy("df").agg(F.sum("by").cast("long").alias("terms")), root, name, "spread")
    entry = {"name": name, "level": 0, "first": seq, "last": seq}
    tombs = state["tombs"] | ({name: gone} if gone else {})
    return compact(spark, root, _commit(spark, root, state | {"last": seq, "segments": [*state["segments"], entry], "tombs": tombs}))


def compact(spark: SparkSession, root: str, state: dict | None = None) -> dict:
    """Merge the segments of a level that has FANOUT of them, up to the top; all of them where tombstones are too many to be broadcast."""
    state = state or manifest(spark, root)
    while True:
        level = next((v for v in sorted({s["level"] for s in state["segments"]}) if sum(s["level"] == v for s in state["segments"]) >= FANOUT), None)
        if sum(state["tombs"].values()) > MAX_TOMBS and len(state["segments"]) > 1:
            state = merge(spark, root, state, state["segments"])
        elif level is not None:
            state = merge(spark, root, state, [s for s in state["segments"] if s["level"] == level])
        else:
            return state


def merge(spark: SparkSession, root: str, state: dict, parts: list[dict]) -> dict:
    """One segment in place of ``parts``, without their dead rows; tombstones of other batches stay, in one folder."""
    names, first, last = [p["name"] for p in parts], min(p["first"] for p in parts), max(p["last"] for p in parts)
    name, tombs = f"{first}-{last}-{uuid.uuid4().hex[:8]}", _tombs(spark, root, state)
    for store in STORES:
        _write(_alive(_read(spark, root, names, store), tombs, state), root, name, store)
    for store in SUMS:
        _write(_added(_read(spark, root, names, store), store), root, name, store)
    tombs.filter((F.col("seq") < first) | (F.col("seq") > last)).write.mode("overwrite").parquet(f"{root}/tombs/{name}")
    left = spark.read.schema("path string, seq long").parquet(f"{root}/tombs/{name}").count()
    entry = {"name": name, "level": max(p["level"] for p in parts) + 1, "first": first, "last": last}
    segments = sorted([*(s for s in state["segments"] if s["name"] not in names), entry], key=lambda s: s["first"])
    return _commit(spark, root, state | {"segments": segments, "tombs": {name: left} if left else {}})


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what the newest manifest does not name; nothing may read older versions any more."""
    state = manifest(spark, root)
    kept = {"segments": {s["name"] for s in state["segments"]}, "tombs": set(state["tombs"]), "manifest": {str(state["version"])}}
    gone = []
    for folder, names in kept.items():
        fs, where = file_system(spark, f"{root}/{folder}")
        for f in fs.listStatus(where) if fs.exists(where) else []:
            if f.getPath().getName() not in names:
                fs.delete(f.getPath(), True)
                gone.append(f"{folder}/{f.getPath().getName()}")
    return gone


def upkeep(changes: DataFrame, root: str, checkpoint: str):
    """A query that brings each batch of a stream of CHANGES into the index."""
    return changes.writeStream.foreachBatch(lambda df, n: apply_batch(df.sparkSession, root, df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
