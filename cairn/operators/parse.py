"""Source files to symbols, imports, calls and chunks. Python is read by its own parser, inside Arrow batches; other
languages by line patterns, which is less than a grammar would give."""

from __future__ import annotations

import ast
import functools
import itertools
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import chunk_id, is_import_line

SYMBOLS = "path string, ord int, name string, symbol_type string, start_line int, end_line int"
EDGES = "path string, ord int, kind string, target string, line int"
#: A line that defines something: the word that says what, its name, and whether a value follows.
DEFINES = r"^\s*(?:async\s+)?(def|function|func|class|const|let|var)\s+(\w+)\s*(=?)"


_DEFINITIONS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
#: The fields that hold statements, or what holds them.
_BODIES = ("body", "orelse", "finalbody", "handlers", "cases")
#: What a node's fields hold below which nothing is defined, imported or called.
_LEAVES = frozenset((
    str, int, bool, type(None), ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal,
    *(k for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop) for k in base.__subclasses__()),
))


def _callee(func: ast.expr) -> str:
    """The name of what is called, with dots; of other expressions only constants may read as one."""
    names, base = [], func
    while type(base) is ast.Attribute:
        names.append(base.attr)
        base = base.value
    if type(base) is ast.Name:
        return ".".join([base.id, *reversed(names)])
    return ast.unparse(func) if type(base) is ast.Constant else ""


def _python_found(source: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols (name, kind, first line, last line) in the order of the text and references (kind, target, line) by line, of one parse and one walk."""
    symbols, edges = [], []
    tree = ast.parse(source)
    todo, at_top = [tree], set(map(id, tree.body))
    while todo:
        node = todo.pop()
        kind = type(node)
        if kind is ast.Call:
            name = _callee(node.func)
            if name.replace(".", "").replace("_", "").isalnum():
                edges.append(("call", name, node.lineno))
        elif kind is ast.Import:
            edges.extend(("import", a.name, node.lineno) for a in node.names)
            continue
        elif kind is ast.ImportFrom:
            if (name := "." * node.level + (node.module or "")) != ".":
                edges.append(("import", name, node.lineno))
            continue
        elif kind in _DEFINITIONS:
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            symbols.append((node.lineno, node.col_offset, (node.name, "class" if kind is ast.ClassDef else "function", first, node.end_lineno)))
        elif kind in (ast.Assign, ast.AnnAssign) and id(node) in at_top:
            targets = node.targets if kind is ast.Assign else [node.target]
            symbols.extend((node.lineno, node.col_offset, (t.id, "variable", node.lineno, node.end_lineno)) for t in targets if type(t) is ast.Name)
        for x in node.__dict__.values():
            if type(x) is list:
                todo += [y for y in x if type(y) not in _LEAVES]
            elif type(x) not in _LEAVES:
                todo.append(x)
    symbols.sort(key=lambda f: f[:2])
    return [f for *_, f in symbols], sorted(edges, key=lambda f: (f[2], f[0], f[1]))


def _python_defined(source: str) -> list[tuple]:
    """The symbols alone, as ``_python_found`` gives them: definitions are statements, so expressions are not walked."""
    symbols, tree = [], ast.parse(source)
    todo, at_top = [tree], set(map(id, tree.body))
    while todo:
        node = todo.pop()
        kind = type(node)
        if kind in _DEFINITIONS:
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            symbols.append((node.lineno, node.col_offset, (node.name, "class" if kind is ast.ClassDef else "function", first, node.end_lineno)))
        elif kind in (ast.Assign, ast.AnnAssign) and id(node) in at_top:
            targets = node.targets if kind is ast.Assign else [node.target]
            symbols.extend((node.lineno, node.col_offset, (t.id, "variable", node.lineno, node.end_lineno)) for t in targets if type(t) is ast.Name)
        own = node.__dict__
        for part in _BODIES:
            if part in own:
                todo += own[part]
    symbols.sort(key=lambda f: f[:2])
    return [f for *_, f in symbols]


#: Small files are read once where copies of them come near each other; those of more characters are not kept.
_SMALL = 1000
_small_found, _small_defined = functools.lru_cache(2048)(_python_found), functools.lru_cache(2048)(_python_defined)


def _found_once(source: str) -> tuple[list[tuple], list[tuple]]:
    return (_small_found if len(source) <= _SMALL else _python_found)(source)


def _python_symbols(path: str, source: str) -> list[tuple]:
    return [(path, k, *f) for k, f in enumerate((_small_defined if len(source) <= _SMALL else _python_defined)(source))]


def _python_edges(path: str, source: str) -> list[tuple]:
    return [(path, k, *f) for k, f in enumerate(_found_once(source)[1])]


#: What a parser says to text that is not its language, or nested deeper than it can follow.
_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


#: Files whose rows are handed on together.
FILES = 1000


def per_file(files: DataFrame, work, schema: str, *more: str, broken=None) -> DataFrame:
    """Rows of ``schema`` that ``work`` makes of each file's path, content and the columns ``more``; of what it cannot read those that
    ``broken`` makes of the path, if any."""
    made = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, FILES) for whole in batches for k in range(0, whole.num_rows, FILES)):
            out = []
            for path, source, *rest in zip(*(b.column(c).to_pylist() for c in ("path", "content", *more)), strict=True):
                try:
                    out += work(path, source or "", *rest)
                except _UNREADABLE:
                    out += [] if broken is None else broken(path)
            columns = zip(*out, strict=True) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, made, strict=True)], schema=made)

    return files.select("path", "content", *more).mapInArrow(run, schema)


def parse_symbols_py(files: DataFrame) -> DataFrame:
    return per_file(files, _python_symbols, SYMBOLS)


def python_rows(path: str, source: str) -> list[tuple]:
    """Symbols and references of a file, parsed once: (path, ord, kind, name, first line, last line)."""
    symbols, edges = _found_once(source)
    return [*((path, k, kind, name, a, b) for k, (name, kind, a, b) in enumerate(symbols)), *((path, k, kind, target, line, line) for k, (kind, target, line) in enumerate(edges))]


def python_symbol_rows(path: str, source: str) -> list[tuple]:
    """The symbols among ``python_rows``."""
    return [(path, k, kind, name, a, b) for path, k, name, kind, a, b in _python_symbols(path, source)]


def python_imports(path: str, source: str) -> list[tuple]:
    """(path, module, line) of a file's imports: only its statements are walked."""
    found, todo = [], [ast.parse(source)]
    while todo:
        node = todo.pop()
        if type(node) is ast.Import:
            found.extend((path, a.name, node.lineno) for a in node.names)
        elif type(node) is ast.ImportFrom:
            if (name := "." * node.level + (node.module or "")) != ".":
                found.append((path, name, node.lineno))
        else:
            own = node.__dict__
            for part in _BODIES:
                if part in own:
                    todo += own[part]
    return found


def extract_edges_py(files: DataFrame) -> DataFrame:
    """Imports and calls with their lines."""
    return per_file(files, _python_edges, EDGES)


def _lines() -> Column:
    """The lines of the column content; an end of line at its end begins no line."""
    return F.split(F.regexp_replace("content", r"\r?\n\z", ""), "\r?\n", -1)


def source_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(_lines()).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def fallback_symbols(files: DataFrame) -> DataFrame:
    """Definitions by line patterns: a function or class reaches to the line before the next one; variables inside such
    a block are part of it. Each file's lines are looked at where they lie: no shuffle, no Python."""
    part = lambda x, k: F.regexp_extract(x, DEFINES, k)

    def mark(x: Column, at: Column) -> Column:
        word = part(x, 1)
        kind = F.when(word.isin("def", "function", "func"), "function").when(word == "class", "class").when(word.isin("const", "let", "var") & (part(x, 3) == "="), "variable")
        return F.struct((at + 1).alias("line"), part(x, 2).alias("name"), kind.alias("kind"))

    cut = files.select("path", _lines().alias("lines"))
    marked = cut.select("path", F.size("lines").alias("n"), F.filter(F.transform("lines", mark), lambda m: m["kind"].isNotNull()).alias("marks"))
    blocks = marked.withColumn("blocks", F.filter("marks", lambda m: m["kind"] != "variable"))
    row = lambda m, end: F.struct(m["name"].alias("name"), m["kind"].alias("symbol_type"), m["line"].alias("start_line"), end.cast("int").alias("end_line"))
    whole = F.transform("blocks", lambda m, k: row(m, F.coalesce(F.get("blocks", k + 1)["line"] - 1, F.col("n"))))
    first = F.get("blocks", F.lit(0))["line"]
    loose = F.transform(F.filter("marks", lambda m: (m["kind"] == "variable") & (first.isNull() | (m["line"] < first))), lambda m: row(m, m["line"]))
    return blocks.select("path", F.explode(F.concat(whole, loose)).alias("s")).select("path", "s.*")


def merge_fallback(parsed: DataFrame, fallback: DataFrame, broken: DataFrame) -> DataFrame:
    """``parsed`` symbols, and those of ``fallback`` that the parser did not see in files (path) whose text has errors. Behind the parsed ones
    (ord) stand the others by their line."""
    columns = ["path", "ord", "name", "symbol_type", "start_line", "end_line"]
    more = fallback.join(broken.select("path").distinct(), "path", "left_semi").join(parsed, ["path", "symbol_type", "name"], "left_anti")
    return parsed.select(columns).unionByName(more.withColumn("ord", F.lit(1_000_000) + F.col("start_line")).select(columns))


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, module, line) of import lines in any of the languages, by pattern."""
    t = F.trim("text")
    module = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"^from\s+(\S+)\s+import", r"from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]", r"^import\s+['\"]([^'\"]+)['\"]", r"^import\s+(?:static\s+)?([\w.]+)")])
    return source_lines(files).filter(is_import_line(F.col("text"))).select("path", module.alias("module"), "line").filter("module is not null")


def chunk_split_lines(files: DataFrame, size: int = 150) -> DataFrame:
    lines = F.split("content", "\n", -1)
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda k: F.struct((k * size + 1).alias("start_line"), F.least((k + 1) * size, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, k * size + 1, F.lit(size)), "\n").alias("content"))))
    return files.select("path", piece.alias("c")).select("path", "c.*")


def chunk_header(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One ``__header__`` chunk per file that has either: its first run of import lines (other lines before it are passed over, a blank or any
    other line ends it), then its variables with all their lines. The range begins at line 1 and ends with as many lines as there are
    imports, or with the last variable; without imports it is the variables'."""
    whole = F.split("content", "\r\n|\r|\n", -1)
    flags = F.transform("whole", lambda x: is_import_line(x))
    first = F.array_position("flags", True).cast("int")
    length = F.array_position(F.slice("flags", F.col("first") + 1, F.size("flags")), False).cast("int")
    cut = files.select("path", whole.alias("whole")).withColumn("flags", flags).withColumn("first", first)
    cut = cut.withColumn("imports", F.when(F.col("first") > 0, F.slice("whole", F.col("first"), F.when(length > 0, length).otherwise(F.size("flags") - F.col("first") + 1))).otherwise(F.slice("whole", 1, 0)))
    spans = symbols.filter("symbol_type = 'variable'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "start_line", "end_line"))).alias("vars"))
    both = cut.join(spans, "path", "left").filter("first > 0 or vars is not null")
    text = lambda v: F.trim(F.array_join(F.slice("whole", v["start_line"], v["end_line"] - v["start_line"] + 1), "\n"))
    n, held = F.size("imports"), F.coalesce("vars", F.array().cast("array<struct<ord:int,start_line:int,end_line:int>>"))
    last = F.array_max(F.transform("vars", lambda v: v["end_line"]))
    start = F.when(n > 0, 1).otherwise(F.array_min(F.transform("vars", lambda v: v["start_line"])))
    return both.select(
        "path", F.lit("__header__").alias("symbol_name"), F.lit("import").alias("chunk_type"), F.array_join(F.concat("imports", F.transform(held, text)), "\n").alias("content"),
        start.cast("int").alias("start_line"), F.greatest(n, last).cast("int").alias("end_line"),
    )


def _bodies(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols`` with their lines. A file's spans meet the file in sorted partitions: texts that are made within a plan are counted there as a few bytes
    each, by which all of them would be broadcast through the driver."""
    spans = symbols.groupBy("path").agg(F.collect_list(F.struct("name", "symbol_type", "start_line", "end_line")).alias("spans"))
    cut = files.join(spans.hint("merge"), "path").select("path", F.split("content", "\r?\n", -1).alias("whole"), F.explode("spans").alias("s"))
    return cut.select("path", "s.*", F.slice("whole", F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1).alias("lines"))


def chunk_symbol(files: DataFrame, symbols: DataFrame, most: int = 200, piece: int = 150) -> DataFrame:
    """A chunk per function or class: name, signature and body; longer ones in pieces of ``piece`` lines."""
    body = _bodies(files, symbols.filter("symbol_type in ('function','class')"))
    lines = F.col("lines")
    signature = F.trim(F.coalesce(F.try_element_at(F.filter(lines, lambda x: ~F.trim(x).startswith("@")), F.lit(1)), F.lit("")))
    n = F.size(lines)
    step = F.when(n > most, piece).otherwise(n)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda k: F.struct((F.col("start_line") + k * step).cast("int").alias("start_line"), F.least(F.col("start_line") + (k + 1) * step - 1, F.col("end_line")).cast("int").alias("end_line"), F.array_join(F.slice(lines, (k * step + 1).cast("int"), step.cast("int")), "\n").alias("body")))
    cut = body.select("path", F.col("name").alias("symbol_name"), F.col("symbol_type").alias("chunk_type"), signature.alias("sig"), F.explode(parts).alias("c"))
    return cut.select("path", "symbol_name", "chunk_type", F.concat("symbol_name", F.lit(" | "), "sig", F.lit("\n"), "c.body").alias("content"), "c.start_line", "c.end_line")


PIECES = "path string, symbol_name string, chunk_type string, content string, start_line int, end_line int"
_CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)


def _cuts(sizes: list[int], least: int) -> list[int]:
    """Where consecutive blocks end once those of fewer than ``least`` lines are gathered: numbers of blocks, as merge_small_blocks
    gathers sizes."""
    ends, gathered = [], 0
    for k, size in enumerate(sizes, 1):
        if size >= least and gathered:
            ends.append(k - 1)
        gathered = 0 if size >= least else gathered + size
        if size >= least or gathered >= least:
            ends.append(k)
            gathered = 0
    if gathered:  # a small rest belongs to the block before it
        ends[-1:] = [len(sizes)]
    return ends


def _logical_blocks(lines: list[str], least: int) -> list[list[str]] | None:
    """The body of a definition cut at its control-flow statements, runs of others together; small blocks gather. Null where
    the lines are not Python."""
    try:
        body = ast.parse(textwrap.dedent("\n".join(lines))).body[0].body
    except (*_UNREADABLE, IndexError, AttributeError):
        return None
    spans, last = [], 0  # (whether it is control flow, lines) of each statement that starts on a line of its own
    for stmt in body:
        first = max(last + 1, min([stmt.lineno, *(d.lineno for d in getattr(stmt, "decorator_list", []))]))
        if own := lines[first - 1 : stmt.end_lineno]:
            spans.append((isinstance(stmt, _CONTROL), [own[0].lstrip(), *own[1:]]))
        last = max(last, stmt.end_lineno)
    number = itertools.count()
    runs = [[x for _, own in group for x in own] for _, group in itertools.groupby(spans, lambda s: next(number) if s[0] else -1)]
    ends = _cuts([len(r) for r in runs], least)
    return [[x for r in runs[a:b] for x in r] for a, b in zip([0, *ends], ends)] or None


def chunk_split_ast(files: DataFrame, symbols: DataFrame, most: int = 200, piece: int = 150, least: int = 40) -> DataFrame:
    """Chunks of Python functions and classes of more than ``most`` lines, cut at their statements; where they do not parse,
    in pieces of ``piece`` lines. Only the definitions' own lines reach Python."""
    python = F.endswith("path", F.lit(".py"))
    long = symbols.filter((F.col("end_line") - F.col("start_line") >= most) & F.col("symbol_type").isin("function", "class") & python)
    bodies = _bodies(files.filter(python), long).select("path", "name", "symbol_type", "start_line", "end_line", "lines")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, name, kind, start, end, body in batch.itertuples(index=False):
                body = list(body)
                signature = next((x.strip() for x in body if not x.strip().startswith("@")), "")
                blocks = _logical_blocks(body, least) or [body[k : k + piece] for k in range(0, len(body), piece)]
                at = start
                for k, b in enumerate(blocks):
                    stop = end if k == len(blocks) - 1 else min(at + len(b) - 1, end)
                    out.append((path, name, kind, "\n".join([f"{name} | {signature}", *b]), at, stop))
                    at = stop + 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return bodies.mapInPandas(run, PIECES)


def chunk_file(files: DataFrame, symbols: DataFrame, most: int = 200) -> DataFrame:
    """Header and symbol chunks; long Python definitions are cut at statements, long ones of other languages by lines."""
    split = F.endswith("path", F.lit(".py")) & (F.col("end_line") - F.col("start_line") >= most)
    whole = chunk_header(files, symbols).unionByName(chunk_symbol(files, symbols.filter(~split), most)).unionByName(chunk_split_ast(files, symbols, most))
    return whole.withColumn("id", chunk_id(F.col("path"), F.col("symbol_name"), F.col("start_line"), F.col("end_line")))


def merge_small_blocks(sizes: Column, least: int = 40) -> Column:
    """Block sizes in order to merged sizes: large blocks stand alone, small ones gather until they are large; a small
    rest joins the block before it."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("held"))

    def step(s: Column, n: Column) -> Column:
        flush = F.when(s["held"] > 0, F.array_append(s["out"], s["held"])).otherwise(s["out"])
        grown = s["held"] + n
        return (
            F.when(n >= least, F.struct(F.array_append(flush, n).alias("out"), F.lit(0).alias("held")))
            .when(grown >= least, F.struct(F.array_append(s["out"], grown).alias("out"), F.lit(0).alias("held")))
            .otherwise(F.struct(s["out"].alias("out"), grown.alias("held")))
        )

    def finish(s: Column) -> Column:
        joined = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.element_at(s["out"], -1) + s["held"]))
        return F.when(s["held"] == 0, s["out"]).when(F.size(s["out"]) == 0, F.array(s["held"])).otherwise(joined)

    return F.aggregate(sizes, state, step, finish)
