"""Operators over source code, logs and reports, bound to every row of a table: each part stands for a few small source files and
each event for a log, made by expressions, so that SQL can state what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import braces, logs, parse, workspace
from cairn.plans.bindings import query, t
from cairn.sources import tables
from cairn.sources.scratch import spread

#: (path, language, lines); ``#`` stands for the part's key.
SOURCES = (
    ("p#/app.py", "python", ("import os", "from utils# import tidy", "", "LIMIT# = 3", "", "", "class Shop#:", "    def sell(self, n):", "        return tidy(n)", "", "", "@cache", "def main#():", "    return Shop#().sell(LIMIT#)")),
    ("p#/view.js", "javascript", ("import { a } from './a#'", "const b# = require('b')", "", "function show#(x) {", "  const y = x // {", "  return y", "}", "class View# {", "  draw(n) { return b#.go(n) }", "}")),
    ("p#/Item#.java", "java", ("package p#;", "import java.util.List;", "", "public class Item# {", "    private int n = 3;", "    public int size(int x) {", "        return helper#.count(x, \"}\");", "    }", "}")),
    ("p#/run.go", "go", ("package main", "import \"fmt\"", "type Box# struct {", "\tn int", "}", "func Run#(x int) int {", "\treturn fmt.Len(x)", "}")),
)
#: What the files define: (path, place in the file, name, kind, first line, last line).
DEFINED = (
    ("p#/app.py", 0, "LIMIT#", "variable", 4, 4), ("p#/app.py", 1, "Shop#", "class", 7, 9), ("p#/app.py", 2, "sell", "function", 8, 9), ("p#/app.py", 3, "main#", "function", 12, 14),
    ("p#/view.js", 0, "b#", "variable", 2, 2), ("p#/view.js", 1, "show#", "function", 4, 7), ("p#/view.js", 2, "View#", "class", 8, 10), ("p#/view.js", 3, "draw", "function", 9, 9),
    ("p#/Item#.java", 0, "Item#", "class", 4, 9), ("p#/Item#.java", 1, "n", "variable", 5, 5), ("p#/Item#.java", 2, "size", "function", 6, 8),
    ("p#/run.go", 0, "Box#", "class", 3, 5), ("p#/run.go", 1, "Run#", "function", 6, 8),
)
#: What they use: (path, place, kind, target, line).
USED = (
    ("p#/app.py", 0, "import", "os", 1), ("p#/app.py", 1, "import", "utils#", 2), ("p#/app.py", 2, "call", "tidy", 9), ("p#/app.py", 3, "call", "Shop#", 14),
    ("p#/view.js", 0, "import", "./a#", 1), ("p#/view.js", 1, "call", "require", 2), ("p#/view.js", 2, "call", "b#.go", 9),
    ("p#/Item#.java", 0, "import", "java.util.List", 2), ("p#/Item#.java", 1, "call", "helper#.count", 7),
    ("p#/run.go", 0, "import", "fmt", 2), ("p#/run.go", 1, "call", "fmt.Len", 7),
)
_LINES = {path: lines for path, _, lines in SOURCES}


def _literal(x) -> str:
    return str(x) if isinstance(x, int) else "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _rows(rows: tuple, columns: str, keys: str = "SELECT p_partkey AS k FROM part") -> str:
    """SQL of ``rows`` for each key, ``#`` replaced by it in all texts."""
    names = columns.split(", ")
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    shown = ", ".join(f"replace({n}, '#', k::VARCHAR) AS {n}" if any(isinstance(r[i], str) for r in rows) else n for i, n in enumerate(names))
    return f"SELECT {shown} FROM ({keys}), (VALUES {values}) v({columns})"


def _files(spark, d) -> DataFrame:
    """(path, content, language) of every part's files."""
    key = F.col("p_partkey").cast("string")
    fill = lambda x: F.replace(F.lit(x), F.lit("#"), key)
    made = F.array(*[F.struct(fill(p).alias("path"), fill("\n".join(lines)).alias("content"), F.lit(lang).alias("language")) for p, lang, lines in SOURCES])
    return spread(t(spark, d, "part").select("p_partkey")).select(F.explode(made).alias("f")).select("f.*")


def _symbols(spark, d) -> DataFrame:
    return workspace.file_symbols(_files(spark, d))


_OF = lambda end: tuple(r for r in DEFINED if r[0].endswith(end))
_USES = lambda end: tuple(r for r in USED if r[0].endswith(end))
_SYMBOL_COLUMNS, _EDGE_COLUMNS = "path, ord, name, symbol_type, start_line, end_line", "path, ord, kind, target, line"


@query(_rows(_OF(".py"), _SYMBOL_COLUMNS))
def parse_symbols_py(spark, d):
    return parse.parse_symbols_py(_files(spark, d).filter("language = 'python'"))


def _braces(language: str, end: str) -> None:
    def parse_symbols(spark, d):
        return braces.parse_symbols_braces(_files(spark, d).filter(F.col("language") == language))

    def extract_calls(spark, d):
        return braces.extract_edges_braces(_files(spark, d).filter(F.col("language") == language))

    parse_symbols.__name__, extract_calls.__name__ = f"parse_symbols_{end}", f"extract_calls_{end}"
    query(_rows(_OF(f".{end}"), _SYMBOL_COLUMNS))(parse_symbols)
    query(_rows(_USES(f".{end}"), _EDGE_COLUMNS))(extract_calls)


for _language, _end in (("javascript", "js"), ("java", "java"), ("go", "go")):
    _braces(_language, _end)


@query(_rows(_USES(".py"), _EDGE_COLUMNS))
def extract_calls(spark, d):
    return parse.extract_edges_py(_files(spark, d).filter("language = 'python'"))


@query(_rows(tuple((p, target, line) for p, _, kind, target, line in USED if kind == "import"), "path, module, line"))
def extract_imports(spark, d):
    return parse.extract_imports(_files(spark, d))


@query(_rows((("p#/view.js", "b#", "variable", 2, 2), ("p#/view.js", "show#", "function", 4, 7), ("p#/view.js", "View#", "class", 8, 10), ("p#/run.go", "Run#", "function", 6, 8)), "path, name, symbol_type, start_line, end_line"))
def fallback_symbols(spark, d):
    """Files of brace languages, by line patterns alone."""
    return parse.fallback_symbols(_files(spark, d).filter("language <> 'python'"))


_MERGED = _rows(tuple((p, *r) for p, _, *r in DEFINED), "path, name, symbol_type, start_line, end_line")


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 3 AS kind, p_size AS n FROM part)
SELECT 'b' || k || '.py' AS path, 'open' || k AS name, 'function' AS symbol_type, 1 AS start_line, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 3 + n ELSE 2 + n END AS end_line FROM p
UNION ALL SELECT 'b' || k || '.py', 'Late' || k, 'class', 4 + n, 5 + n FROM p WHERE kind <> 2
UNION ALL SELECT 'b' || k || '.py', 'n' || k, 'variable', 3, 3 FROM p WHERE kind = 0
UNION ALL SELECT 'b' || k || '.py', 'g', 'function', 5 + n, 5 + n FROM p WHERE kind = 0""")
def merge_fallback(spark, d):
    """Files that parse (p_size % 3 = 0), do not (1), or end in their first function (2): symbols of the parser, or by line patterns."""
    n, key = F.col("p_size"), F.col("p_partkey").cast("string")
    fill = lambda x: F.replace(F.lit(x), F.lit("#"), key)
    kind = n % 3
    lines = F.concat(
        F.array(fill("def open#(x):"), fill("    return x"), F.when(kind == 0, fill("n# = 1")).otherwise("    oops ((")),
        F.array_repeat(F.lit(""), n),
        F.when(kind == 2, F.array().cast("array<string>")).otherwise(F.array(fill("class Late#:"), F.when(kind == 0, "    def g(self): pass").otherwise("    x = ["))),
    )
    files = spread(t(spark, d, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("b"), key, F.lit(".py")).alias("path"), F.array_join(lines, "\n").alias("content"), F.lit("python").alias("language"))
    return workspace.file_symbols(files).select("path", "name", "symbol_type", "start_line", "end_line")


@query(f"SELECT * FROM ({_MERGED}) WHERE path = 'p7/app.py'")
def index_symbols(spark, d):
    return tables.index_symbols(_symbols(spark, d), "p7/app.py").drop("ord")


@query(f"SELECT path, count(*) AS symbols FROM ({_MERGED}) GROUP BY path")
def symbol_counts(spark, d):
    return tables.symbol_counts(_symbols(spark, d))


_CHUNK = "path, symbol_name, chunk_type, content, start_line, end_line"
_HEADERS = (
    ("p#/app.py", "__header__", "import", "import os\nfrom utils# import tidy\nLIMIT# = 3", 1, 4), ("p#/view.js", "__header__", "import", "import { a } from './a#'\nconst b# = require('b')", 1, 2),
    ("p#/Item#.java", "__header__", "import", "package p#;\nimport java.util.List;\nprivate int n = 3;", 1, 5), ("p#/run.go", "__header__", "import", "package main\nimport \"fmt\"", 1, 2),
)
_BODIES = tuple(
    (p, name, kind, f"{name} | {next(x.strip() for x in _LINES[p][a - 1 : b] if not x.startswith('@'))}\n" + "\n".join(_LINES[p][a - 1 : b]), a, b)
    for p, _, name, kind, a, b in DEFINED if kind != "variable"
)


@query(_rows(_HEADERS, _CHUNK))
def chunk_header(spark, d):
    return parse.chunk_header(_files(spark, d), _symbols(spark, d))


@query(_rows(_BODIES, _CHUNK))
def chunk_symbol(spark, d):
    return parse.chunk_symbol(_files(spark, d), _symbols(spark, d))


@query(f"SELECT *, left(sha256(path || ':' || symbol_name || ':' || start_line || '-' || end_line), 16) AS id FROM ({_rows(_HEADERS + _BODIES, _CHUNK)})")
def chunk_file(spark, d):
    return parse.chunk_file(_files(spark, d), _symbols(spark, d))


# a function of 5 + 4 * 60 lines in each nation's file: four loops of 60 lines, which stand alone, and short runs between them
_LOOP = "\n".join(["    for i in range(n):", *(f"        total += i * {k}" for k in range(59))])
_LONG = "def big(n):\n    total = 0\n" + "\n    n -= 1\n".join([_LOOP] * 4) + "\n    return total"


def _long_pieces() -> tuple:
    """Each loop is a piece; the run before the first stands before it, and those between and after are small: they gather, and are
    handed out before the next loop, or join the last piece."""
    loop = _LOOP.lstrip().split("\n")
    blocks = [["total = 0"], loop, ["n -= 1"], loop, ["n -= 1"], loop, ["n -= 1"], [*loop, "return total"]]
    at, out = 1, []
    for k, b in enumerate(blocks):
        stop = 246 if k == len(blocks) - 1 else at + len(b) - 1
        out.append(("n#.py", "big", "function", "\n".join(["big | def big(n):", *b]), at, stop))
        at = stop + 1
    return tuple(out)


@query(_rows(_long_pieces(), _CHUNK, "SELECT n_nationkey AS k FROM nation"))
def chunk_split_ast(spark, d):
    files = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("path"), F.lit(_LONG).alias("content"))
    return parse.chunk_split_ast(files, parse.parse_symbols_py(files))


# --- logs and reports -------------------------------------------------------------------------------------------------

#: A log for each event, by its number modulo their count; ``#`` stands for the number.
LOGS = (
    "Traceback (most recent call last):\n  File \"/w/run.py\", line 10, in run\n    go()\n  File \"/w/pkg/m#.py\", line #, in go\n    x = y\nNameError: name 'y#' is not defined",
    "TypeError: boom #\n    at load (/w/src/app.ts:#:7)\n    at main (/w/src/main.js:3:1)",
    "main.c:#:5: error: expected ';' before '}'",
    "src/a.ts(#,5): error TS2307: Cannot find module 'm#'",
    "error[E0425]: cannot find value `x#` in this scope\n --> src/main.rs:#:10",
    "FAILED test_a.py::test_b - AssertionError: expected #",
    "SyntaxError: invalid syntax (calc#.py, line #)",
    "npm ERR! code #\nnpm ERR! failed to build #\nsee log",
    "  ",
)
_ERROR_COLUMNS = "w, error_type, error_message, file_path, line, col, language, parse_strategy, code_snippet"
_TRACEBACK = ((0, "NameError", "name 'y#' is not defined", "pkg/m#.py", "#", None, "python", "python_traceback", "go()\nx = y"),)
_STACK = ((1, "TypeError", "boom #", "src/app.ts", "#", "7", "typescript", "js_stack", None),)
_COMPILER = (
    (2, "CompileError", "expected ';' before '}'", "main.c", "#", "5", "c", "gcc_compiler", None), (3, "CompileError", "Cannot find module 'm#'", "src/a.ts", "#", "5", "typescript", "ts_compiler", None),
    (4, "RustErrorE0425", "cannot find value `x#` in this scope", "src/main.rs", "#", "10", "rust", "rustc_compiler", None),
)
_DIRECT = (
    (5, "AssertionError", "expected #", None, None, None, "python", "pytest_error", None), (6, "SyntaxError", "invalid syntax", "calc#.py", "#", None, "python", "python_direct", None),
)
_LAST = ((7, "Unknown", "npm ERR! failed to build #", None, None, None, None, "fallback", None), (8, "Unknown", "(empty)", None, None, None, None, "fallback", None))


def _errors(found: tuple) -> str:
    """SQL: each event with what its log says, if that is among ``found``."""
    columns = [c for c in _ERROR_COLUMNS.split(", ") if c != "w"]
    shown = ", ".join(f"try_cast(replace({c}, '#', event_id::VARCHAR) AS INT) AS {c}" if c in ("line", "col") else f"replace({c}, '#', event_id::VARCHAR) AS {c}" for c in columns)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in found)
    return f"SELECT event_id, {shown} FROM events LEFT JOIN (VALUES {values}) v({_ERROR_COLUMNS}) ON event_id % {len(LOGS)} = w"


def _logs(spark, d) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, LOGS)), (F.col("event_id") % len(LOGS) + 1).cast("int"))
    return t(spark, d, "events").select("event_id", F.replace(raw, F.lit("#"), F.col("event_id").cast("string")).alias("raw"), F.lit("/w").alias("cwd"))


def _chain(name: str, found: tuple, column) -> None:
    def run(spark, d):
        return _logs(spark, d).select("event_id", column(F.col("raw"), F.col("cwd")).alias("e")).select("event_id", "e.*")

    run.__name__ = name
    query(_errors(found))(run)


_chain("err_py_traceback", _TRACEBACK, logs.err_py_traceback)
_chain("err_js_stack", _STACK, logs.err_js_stack)
_chain("err_compiler", _COMPILER, logs.err_compiler)
_chain("err_py_direct", ((1, "TypeError", "boom #", None, None, None, "python", "python_direct", None), *_DIRECT), logs.err_py_direct)
_chain("parse_error", (*_TRACEBACK, *_STACK, *_COMPILER, *_DIRECT, *_LAST), logs.parse_error)


@query(r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(right(regexp_replace(text, '^\s+|\s+$', '', 'g'), 200), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
y AS (SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(lower(x), 'error|failed|fatal|exception|traceback')) AS m FROM x)
SELECT doc_id, 'Unknown' AS error_type, coalesce(m[-1], l[1], '(empty)') AS error_message FROM y""")
def err_fallback(spark, d):
    return t(spark, d, "documents").select("doc_id", logs.err_fallback(F.coalesce("text", F.lit(""))).alias("e")).select("doc_id", "e.error_type", "e.error_message")


def _reports(spark, d) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("good"), (F.col("l_linenumber") - 1).alias("bad"),
    ).select(
        "l_orderkey", "l_linenumber",
        F.concat(F.when(F.col("bad") > 0, F.concat(F.lit("FAILED t/test_a.py::test_"), n("bad"), F.lit(" - assert 3 == "), n("good"), F.lit("\n"), n("bad"), F.lit(" failed, "))).otherwise(""), n("good"), F.lit(" passed, 1 skipped in 0.2s")).alias("pytest"),
        _jest(n).alias("jest"), F.when(F.col("bad") > 0, 1).otherwise(0).alias("code"),
    )


def _jest(n):
    """Four forms of the summary line, by the order's key; each failed test has its line before it."""
    form = F.col("l_orderkey") % 4
    line = (
        F.when(form == 0, F.concat(F.lit("Tests:       "), n("bad"), F.lit(" failed, "), n("good"), F.lit(" passed, 1 skipped")))
        .when(form == 1, F.concat(F.lit("Tests: "), n("good"), F.lit(" passed, 9 total"))).when(form == 2, F.concat(F.lit("Tests: "), n("bad"), F.lit(" failed, "), n("good"), F.lit(" passed")))
        .otherwise("sh: jest: not found")
    )
    marks = F.transform(F.sequence(F.lit(0), F.col("bad")), lambda k: F.concat(F.lit("  ● suite › test "), k.cast("string"), F.lit("  \n")))
    return F.concat(F.array_join(F.slice(marks, 2, F.lit(99)), ""), line)


_REPORT = "l_orderkey, l_linenumber, l_linenumber = 1 AS success, l_quantity::INT AS passed, (l_linenumber - 1)::INT AS failed"


@query(f"""SELECT {_REPORT}, 0 AS errors, 1 AS skipped, (l_quantity + l_linenumber)::INT AS total,
 CASE WHEN l_linenumber = 1 THEN '' ELSE 't/test_a.py::test_' || (l_linenumber - 1) || '=assert 3 == ' || l_quantity::INT END AS failures FROM lineitem""")
def parse_pytest(spark, d):
    r = _reports(spark, d).select("l_orderkey", "l_linenumber", logs.parse_pytest(F.col("pytest"), F.lit(""), F.col("code")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return r.withColumn("failures", F.array_join(F.transform("failures", lambda x: F.concat(x["test_name"], F.lit("="), x["error"])), ";"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS bad, l_quantity::INT AS good, l_orderkey % 4 AS form FROM lineitem),
c AS (SELECT *, CASE form WHEN 0 THEN bad WHEN 1 THEN 0 ELSE (bad > 0)::INT END AS failed, CASE WHEN form < 2 THEN good ELSE 0 END AS passed, (form = 0)::INT AS skipped FROM r)
SELECT l_orderkey, l_linenumber, bad = 0 AS success, passed, failed::INT AS failed, skipped, (passed + failed + skipped)::INT AS total,
 array_to_string(list_transform(range(1, bad + 1), lambda k: 'suite › test ' || k || '=test failed'), ';') AS failures FROM c""")
def parse_jest(spark, d):
    r = _reports(spark, d).select("l_orderkey", "l_linenumber", logs.parse_jest(F.col("jest"), F.lit(""), F.col("code")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return r.withColumn("failures", F.array_join(F.transform("failures", lambda x: F.concat(x["test_name"], F.lit("="), x["error"])), ";"))


@query("SELECT event_id, props AS first, props AS greedy FROM events")
def json_first_object(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("note "), "props", F.lit(" end }")).alias("s"))
    return e.select("event_id", logs.json_first_object(F.col("s")).alias("first"), X.json_greedy(F.replace("s", F.lit(" end }"), F.lit(""))).alias("greedy"))


@query(r"""WITH x AS (SELECT doc_id, (string_split(text, chr(10)))[1:3] AS a, list_transform((string_split(text, chr(10)))[1:3], lambda x: x || '#') AS b FROM documents),
y AS (SELECT doc_id, list_transform(a, lambda x: '-' || x) || list_transform(b, lambda x: '+' || x) AS l, len(a) AS n FROM x)
SELECT doc_id, '--- a/f' || chr(10) || '+++ b/f' || chr(10) || CASE WHEN n = 1 THEN '@@ -1 +1 @@' ELSE '@@ -1,' || n || ' +1,' || n || ' @@' END || chr(10) || array_to_string(l, chr(10)) || chr(10) AS diff FROM y""")
def unified_diff(spark, d):
    """The first three lines of each document, of which every one changes."""
    lines = F.slice(F.split("text", "\n", -1), 1, 3)
    old, new = (F.concat(F.array_join(x, "\n"), F.lit("\n")) for x in (lines, F.transform(lines, lambda x: F.concat(x, F.lit("#")))))
    return t(spark, d, "documents").select("doc_id", logs.unified_diff(F.lit("f"), old, new, F.lit(3)).alias("diff"))


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) ELSE '' END AS old_content, p_name || '!' || chr(10) AS new_content, '--- a/' || p_partkey || chr(10) || '+++ b/' || p_partkey || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '@@ -1 +1 @@' || chr(10) || '-' || p_name ELSE '@@ -0,0 +1 @@' END || chr(10) || '+' || p_name || '!' || chr(10) AS diff FROM part")
def build_diff_files(spark, d):
    key, line = F.col("p_partkey").cast("string").alias("path"), lambda c: F.concat("p_name", F.lit(c)).alias("content")
    part = t(spark, d, "part")
    return logs.build_diff_files(part.select(key, line("!\n")), part.filter("p_partkey % 2 = 0").select(key, line("\n")))
