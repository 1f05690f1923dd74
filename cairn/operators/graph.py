"""Graph operators over an edge table, and plans of steps as graphs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions.text import detect_language, looks_local_module, match_call_target
from cairn.sources.scratch import materialize

# What the path of an imported script may end with, in order.
SCRIPT_ENDS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.ts")


def graph_bfs(edges: DataFrame, start: str, depth: int = 2, direction: str = "downstream", files: DataFrame | None = None) -> DataFrame:
    """(node, direction, depth, via): every node reached at its least depth, by its first edge. Upstream is what ``start`` imports, downstream who
    imports it. ``depth`` is 1 to 5. With ``files`` (file_path) only files are reached; without, names of unresolved modules are nodes
    too. The edges are written once, and so is each level, so that no level is worked out twice."""
    a, b = ("source", "target") if direction == "upstream" else ("target", "source")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if files is not None:
        e = e.join(files.select(F.col("file_path").alias("b")).distinct(), "b", "left_semi")
    e = materialize(e, "edges")
    seen = edges.sparkSession.createDataFrame([(start, 0, None)], "node string, depth int, via string")
    levels = [seen]
    for d in range(1, min(5, max(1, depth)) + 1):
        step = levels[-1].select(F.col("node").alias("a")).join(e, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("via"))
        known = reduce(DataFrame.union, (x.select("node") for x in levels))
        levels.append(materialize(step.join(known, "node", "left_anti").select("node", F.lit(d).alias("depth"), "via"), "level"))
    return reduce(DataFrame.unionByName, levels[1:]).select("node", F.lit(direction).alias("direction"), "depth", "via")


def graph_imports(edges: DataFrame, files: DataFrame, source: str) -> DataFrame:
    known = files.select(F.col("file_path").alias("target")).distinct().withColumn("found", F.lit(True))
    return edges.filter(F.col("source") == source).join(known, "target", "left").select("source", "target", F.coalesce("found", F.lit(False)).alias("resolved"))


def graph_symbols(calls: DataFrame, path: str | None = None) -> DataFrame:
    return calls if path is None else calls.filter((F.col("source") == path) | F.startswith(F.col("source"), F.lit(path + "::")))


def graph_stats(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the files of the workspace (file_path), and the different import and call edges."""
    each = edges.groupBy("edge_type", "source", "target").agg(F.lit(1).alias("one")).select("edge_type")
    rows = each.unionByName(files.groupBy("file_path").agg(F.lit("file").alias("edge_type")).select("edge_type"))
    count = lambda kind: F.count_if(F.col("edge_type") == kind)
    return rows.agg(count("file").alias("files"), count("import").alias("import_edges"), count("call").alias("call_edges"))


def graph_remove_file(edges: DataFrame, path: str) -> DataFrame:
    gone = (F.col("source") == path) | (F.col("target") == path) | F.startswith(F.col("source"), F.lit(path + "::"))
    return edges.filter(~gone)


def find_callers(calls: DataFrame, name: str, limit: int = 20) -> DataFrame:
    hit = calls.filter(match_call_target(F.col("target"), F.lit(name)))
    file = F.when(F.contains("source", F.lit("::")), F.regexp_extract("source", r"(?s)^(.*)::[^:]*$", 1)).otherwise(F.col("source"))
    return hit.select(file.alias("file"), F.when(F.contains("source", F.lit("::")), F.regexp_extract("source", r"::([^:]*)$", 1)).alias("caller"), "line", "target").orderBy("file", "line", "caller", "target").limit(limit)


def find_related_symbols(symbols: DataFrame, name: str, exclude: str, limit: int = 20) -> DataFrame:
    hit = symbols.filter((F.lower("name") == name.lower()) & (F.col("file") != exclude))
    return hit.select("file", "line", "name").orderBy("file", "line").limit(limit)


def cue_suggest(calls: DataFrame, symbols: DataFrame, change: str, name: str, current: str, cap: int = 20) -> DataFrame:
    """Places that an edit touches. Callers are limited before the current file is taken out, as the service does."""
    hits = find_related_symbols(symbols, name, current).select("file", "line") if change == "add_method" else find_callers(calls, name).select("file", "line")
    return hits.filter((F.col("file") != current) & (F.col("line") >= 1)).orderBy("file", "line").limit(cap)


_POINTS = "file string, line int, ord long, name string, symbol string"


def _enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep over rows (file, line, last, ord, name) in the order of file and line, a span's start before a point on its line. Spans that have
    begun wait by their place in the list; those that have ended are dropped when they come up. A point, without last, is given back with what holds it."""
    file, begun = None, []
    for b in batches:
        out = []
        for f, line, last, place, name in zip(*(b[c].to_pylist() for c in ("file", "line", "last", "ord", "name")), strict=True):
            if f != file:
                file, begun = f, []
            if last is not None:
                heapq.heappush(begun, (place, last, name))
                continue
            while begun and begun[0][1] < line:
                heapq.heappop(begun)
            out.append((f, line, place, name, begun[0][2] if begun else None))
        kinds = {"file": pa.string(), "line": pa.int32(), "ord": pa.int64(), "name": pa.string(), "symbol": pa.string()}
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _swept(points: DataFrame, spans: DataFrame, *parts: int) -> DataFrame:
    """``points`` (file, line, ord, name) with the symbol that holds each, or null; one sweep over each file."""
    starts = spans.filter("name is not null and end_line is not null and file is not null and start_line is not null")
    starts = starts.select("file", F.col("start_line").cast("int").alias("line"), F.col("end_line").cast("int").alias("last"), F.col("ord").cast("long").alias("ord"), "name")
    asked = points.select("file", F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("last"), F.col("ord").cast("long").alias("ord"), "name")
    both = starts.unionByName(asked).withColumns({"file": F.col("file").cast("string"), "name": F.col("name").cast("string")})
    return both.repartition(*parts, "file").sortWithinPartitions("file", "line", F.col("last").isNull()).mapInArrow(_enclose, _POINTS)


def enclosing_symbol(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (file, line) with the first span in list order (ord) that holds the line: one sweep over each file's starts and points, so that
    work grows with their number and not with their product. Of spans without a name or with null ends none holds a line."""
    asked = points.select("file", F.col("line").cast("int").alias("line")).distinct().filter("file is not null and line is not null")
    kinds = dict(asked.dtypes)["file"], dict(spans.dtypes)["name"]
    held = _swept(asked.withColumns({"ord": F.lit(None), "name": F.lit(None).cast(kinds[1])}), spans).filter("symbol is not null")
    return held.select(F.col("file").cast(kinds[0]).alias("file"), "line", F.col("symbol").cast(kinds[1]).alias("symbol"))


def candidate_paths(module: Column, language: Column) -> Column:
    """Paths that a module may have in the workspace, in the order in which they are tried."""
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    bare = F.regexp_replace(module, r"^[./]+", "")
    script = F.array(*[F.concat(bare, F.lit(end)) for end in SCRIPT_ENDS])
    none = F.array().cast("array<string>")
    return (
        F.when(language == "python", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
        .when(language.isin("javascript", "typescript"), F.when(module.rlike("^[./]"), script).otherwise(none))
        .when(language == "java", F.array(F.concat(dotted, F.lit(".java"))))
        .when((language == "go") & ~module.startswith("/"), F.array(F.concat(F.substring_index(module, "/", -1), F.lit(".go"))))
        .otherwise(none)
    )


#: References that a partition is dealt where they are shuffled. Texts that are much alike shrink so far that partitions measured by bytes would hold millions.
REFERENCES = 500_000


def _parts(rows: DataFrame, each: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def resolve_import(imports: DataFrame, files: DataFrame, suffixes: bool = False, parts: int = 0) -> DataFrame:
    """(language, module, target) for each different module of ``imports`` (language, module): the first of its candidate paths that is one of ``files``
    (file_path), else null. A module that many files import is resolved once. With ``suffixes`` a module without such a file may also be
    the file whose path ends with a candidate at a folder's border: the shortest, then the least. Work is dealt to ``parts`` partitions, or by the number of modules."""
    modules = imports.select("language", "module").distinct()
    if not parts:
        modules = materialize(modules, "modules")
        parts = _parts(modules, REFERENCES // 4)  # each has several candidates
    tried = modules.select("language", "module", F.posexplode_outer(candidate_paths(F.col("module"), F.col("language"))).alias("place", "file_path"))
    known = files.select("file_path").repartition(parts, "file_path").distinct()
    found = known.select("file_path", F.lit(0).alias("longer"), F.col("file_path").alias("target"))
    if suffixes:
        parts = F.split("file_path", "/")
        ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
        index = known.filter(F.size(parts) > 1).select(F.col("file_path").alias("target"), F.explode(ends).alias("file_path"))
        found = found.unionByName(index.select("file_path", F.length("target").alias("longer"), "target"))
    # modules without a file stay in the one join
    best = F.min(F.when(F.col("target").isNotNull(), F.struct(F.col("longer") > 0, "place", "longer", "target"))).alias("best")
    met = tried.repartition(parts, "file_path").join(found, "file_path", "left").repartition(parts, "language", "module")
    return met.groupBy("language", "module").agg(best).select("language", "module", F.col("best.target").alias("target"))


def build_edges(refs: DataFrame, spans: DataFrame, files: DataFrame, suffixes: bool = False) -> DataFrame:
    """Edges (source, target, edge_type, source_type, line, raw) from the references (path, ord, kind, target, line) of files to modules and callables.

    An import leads to the file that its module resolves to; one that resolves to none, or to the file itself, keeps the module's name where it looks
    local to the language. A call starts at the first of the file's symbols ``spans`` (path, ord, name, start_line, end_line) that holds
    its line, as path::name, or at the file. Of repeated edges the last one's line stays."""
    language = detect_language(F.col("path"))
    imports = refs.filter("kind = 'import'").select("path", "ord", F.col("target").alias("module"), "line", language.alias("language"))
    parts = _parts(refs, REFERENCES)
    met = imports.join(resolve_import(imports, files, suffixes, parts), ["language", "module"])
    outside = F.col("target").isNull() | (F.col("target") == F.col("path"))
    target = F.when(~outside, F.col("target")).when(looks_local_module(F.col("module"), F.col("language")), F.col("module"))
    file_edges = met.select(
        F.col("path").alias("source"), target.alias("target"), F.lit("import").alias("edge_type"), F.lit("file").alias("source_type"), "ord", "line", F.col("module").alias("raw")
    )
    calls = refs.filter("kind = 'call'").select(F.col("path").alias("file"), "line", "ord", F.col("target").alias("name"))
    inside = _swept(calls, spans.withColumnRenamed("path", "file"), parts).withColumnRenamed("name", "target")
    source = F.when(F.col("symbol").isNotNull(), F.concat("file", F.lit("::"), "symbol")).otherwise(F.col("file"))
    kind = F.when(F.col("symbol").isNotNull(), "symbol").otherwise("file")
    call_edges = inside.select(source.alias("source"), "target", F.lit("call").alias("edge_type"), kind.alias("source_type"), "ord", "line", F.col("target").alias("raw"))
    every = file_edges.filter("target is not null").unionByName(call_edges)
    last = every.repartition(parts, "source", "target", "edge_type").groupBy("source", "target", "edge_type").agg(F.max_by(F.struct("source_type", "line", "raw"), "ord").alias("e"))
    return last.select("source", "target", "edge_type", "e.*")


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` (plan, id, dep) without those that lie on no way from a cycle to a cycle: steps that nothing depends on, or that depend on nothing, go
    until none is left."""
    left = None
    while left != (left := edges.count()) and left:
        asked = edges.select("plan", F.col("dep").alias("id")).distinct()
        asking = edges.select("plan", F.col("id").alias("dep")).distinct()
        edges = materialize(edges.join(asked, ["plan", "id"], "left_semi").join(asking, ["plan", "dep"], "left_semi").select("plan", "id", "dep"), "deps")
    return edges


def _spread_least(edges: DataFrame, start: DataFrame, a: str, b: str) -> DataFrame:
    """(plan, node, mark): the least mark of ``start`` that reaches each node along the edges from ``a`` to ``b``. Edges of a round may lead two, four, ...
    steps on, one shortcut a node, so that long ways take few rounds; there are never more shortcuts than nodes."""
    marks = start
    ways = edges.select("plan", F.col(a).alias("node"), F.col(b).alias("to"))
    jump = materialize(ways.groupBy("plan", "node").agg(F.min("to").alias("to")), "jumps")
    moved = 1
    while moved:
        along = ways.unionByName(jump).join(marks, ["plan", "node"]).select("plan", F.col("to").alias("node"), "mark")
        best = marks.unionByName(along).groupBy("plan", "node").agg(F.min("mark").alias("mark"))
        best = materialize(best, "marks")
        moved = best.join(marks.withColumnRenamed("mark", "old"), ["plan", "node"], "left").filter("old is null or old <> mark").count()
        marks = best
        two = jump.join(jump.select("plan", F.col("node").alias("to"), F.col("to").alias("far")), ["plan", "to"]).select("plan", "node", F.col("far").alias("to"))
        jump = materialize(two, "jumps")
    return marks


def _on_cycles(edges: list[tuple]) -> list:
    """The steps of components with more than one step (Tarjan), of edges (id, dep)."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    number, low, stack, found = {}, {}, [], []
    for start in out:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack.append(start)
        way = [(start, iter(out[start]))]
        held = {start}
        while way:
            node, rest = way[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    held.add(to)
                    way.append((to, iter(out.get(to, ()))))
                    break
                if to in held:
                    low[node] = min(low[node], number[to])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == number[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    found += part if len(part) > 1 else []
    return found


#: A plan of so many edges or fewer is looked at by the task that gets it; those of more by all tasks together.
PLAN_EDGES = 100_000


def cycles(edges: DataFrame, most: int = PLAN_EDGES) -> DataFrame:
    """(plan, id): the steps on a cycle of ``edges`` (plan, id, dep), without edges from a step to itself. Plans of at most ``most`` edges
    stream by, each held by itself; the edges of larger ones are moved in rounds."""
    edges = materialize(edges.filter("plan is not null and id is not null and dep is not null"), "deps")
    large = materialize(edges.groupBy("plan").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("plan"), "large")
    some = bool(large.head(1))
    schema = edges.select("plan", "id").schema
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, own, found = None, [], []
        for b in batches:
            for p, a, to in zip(*(b.column(c).to_pylist() for c in ("plan", "id", "dep")), strict=True):
                if p != plan:
                    found += [(plan, x) for x in _on_cycles(own)]
                    plan, own = p, []
                own.append((a, to))
            yield _rows_of(found, made)
            found = []
        yield _rows_of([(plan, x) for x in _on_cycles(own)], made)

    small = edges.join(F.broadcast(large), "plan", "left_anti") if some else edges
    on = small.repartition("plan").sortWithinPartitions("plan").mapInArrow(run, schema)
    return on.unionByName(_cycles_of_large(edges.join(F.broadcast(large), "plan", "left_semi"))) if some else on


def _rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _cycles_of_large(edges: DataFrame) -> DataFrame:
    """As ``cycles``, whatever a plan's size.

    What trimming leaves is coloured: each step gets the least step that reaches it, and a step is of one component with its colour where
    it reaches that step in turn, along steps of the colour. Such components with more than one step are cycles; they are taken out, and the rest is trimmed
    again. Each round reads and writes as many rows as there are edges and steps left."""
    found, edges = [], _trimmed(materialize(edges, "deps"))
    while edges.count():
        steps = edges.select("plan", F.col("id").alias("node")).union(edges.select("plan", F.col("dep").alias("node"))).distinct()
        colour = _spread_least(edges, steps.withColumn("mark", F.col("node")), "id", "dep")
        ends = colour.select("plan", F.col("node").alias("id"), F.col("mark").alias("c"))
        other = ends.select("plan", F.col("id").alias("dep"), F.col("c").alias("d"))
        same = edges.join(ends, ["plan", "id"]).join(other, ["plan", "dep"]).filter("c = d").select("plan", "id", "dep")
        same = materialize(same, "same")
        # backwards from the step that gave the colour
        roots = colour.filter("node = mark")
        back = _spread_least(same, roots, "dep", "id").select("plan", F.col("node").alias("id"))
        inner = same.join(back, ["plan", "id"], "left_semi").join(back.withColumnRenamed("id", "dep"), ["plan", "dep"], "left_semi")
        on = materialize(inner.select("plan", "id").union(inner.select("plan", F.col("dep").alias("id"))).distinct(), "cycle")
        found.append(on)
        roots_and = back.unionByName(on).distinct()
        rest = edges.join(roots_and, ["plan", "id"], "left_anti").join(roots_and.withColumnRenamed("id", "dep"), ["plan", "dep"], "left_anti")
        edges = _trimmed(materialize(rest.select("plan", "id", "dep"), "deps"))
    return reduce(DataFrame.unionByName, found) if found else edges.select("plan", "id")


def dag_validate(steps: DataFrame) -> DataFrame:
    """One row per violation: missing and self dependencies, and steps on a cycle of any length."""
    deps = steps.select("plan", "id", F.explode("deps").alias("dep"))
    ids = steps.select("plan", F.col("id").alias("dep"))
    missing = deps.join(ids, ["plan", "dep"], "left_anti").select("plan", "id", F.lit("missing").alias("violation"))
    own = deps.filter("id = dep").select("plan", "id", F.lit("self").alias("violation"))
    cycle = cycles(deps.filter("id <> dep").distinct()).select("plan", "id", F.lit("cycle").alias("violation"))
    return reduce(DataFrame.unionByName, [missing, own, cycle]).distinct()


def dag_runnable(steps: DataFrame) -> DataFrame:
    """Per plan the first pending step, in plan order, whose dependencies are all done."""
    pending = steps.filter("status = 'pending'")
    done = steps.filter("status = 'done'").select("plan", F.col("id").alias("dep"))
    unmet = pending.select("plan", "id", F.explode("deps").alias("dep")).join(done, ["plan", "dep"], "left_anti").select("plan", "id")
    return pending.join(unmet, ["plan", "id"], "left_anti").groupBy("plan").agg(F.min_by("id", "ord").alias("id"))


STATUSES = ("pending", "running", "done", "failed", "blocked")
LEGAL_MOVES = tuple(f"{a}>{b}" for a, b in (("pending", "running"), ("running", "done"), ("running", "failed"), ("pending", "blocked"), ("running", "blocked"), ("failed", "blocked"), ("failed", "pending"), ("blocked", "pending"), ("running", "pending")))


def step_transition(log: DataFrame) -> DataFrame:
    """Illegal moves in a status log (id, ord, status); repeats are legal."""
    moved = log.withColumn("before", F.lag("status").over(W.partitionBy("id").orderBy("ord", "status")))
    return moved.filter((F.col("before") != F.col("status")) & ~F.concat("before", F.lit(">"), "status").isin(*LEGAL_MOVES))


def step_summary(steps: DataFrame) -> DataFrame:
    """Steps by status per plan, zero where there is none."""
    return steps.groupBy("plan").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in STATUSES])


def plan_progress(steps: DataFrame) -> DataFrame:
    done, n = F.sum((F.col("status") == "done").cast("long")), F.count(F.lit(1))
    return steps.groupBy("plan").agg(
        (done / n).alias("progress"), F.bround(100 * done / n).cast("int").alias("percent"),
        F.bool_and(F.col("status").isin("done", "blocked")).alias("all_done"), F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )


def fail_remaining(steps: DataFrame, reason: str) -> DataFrame:
    open_ = F.col("status").isin("pending", "running")
    return steps.withColumn("reason", F.when(open_, F.lit(reason))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))
