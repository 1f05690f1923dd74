"""Files to symbols, imports and calls; cycles; enclosing symbols. Expectations are literal, from the described behaviour, or worked out by hand here."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import context, graph, logs, parse, workspace
from cairn.sources import tables
from cairn.functions import text as X

FILES = "path string, content string, language string"


def files_of(spark, pairs):
    frame = spark.createDataFrame([(p, c) for p, c in pairs], "path string, content string")
    return frame.withColumn("language", X.detect_language(F.col("path")))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


APP = [
    ("app.py", "import utils\nfrom helpers import to_json\nimport app\nimport requests\nfrom . import x\nfrom _private import y\n\ndef main():\n    d = utils.format_data(1)\n    return to_json(d)\n\nmain()\n"),
    ("utils.py", "from helpers import to_json\n\nclass Tool:\n    def run(self):\n        return to_json(self)\n\n\ndef format_data(x):\n    return to_json(x)\n"),
    ("helpers.py", "import json\n\ndef to_json(x):\n    return json.dumps(x)\n"),
]


def test_graph_from_files(spark):
    edges = workspace.file_edges(files_of(spark, APP))
    got = {(r.source, r.target, r.edge_type, r.source_type, r.line) for r in edges.collect()}
    imports = {(s, t, n) for s, t, kind, _, n in got if kind == "import"}
    # a file that imports itself and a module that is not there keep the module's name; private names and "." do not count
    assert imports == {("app.py", "utils.py", 1), ("app.py", "helpers.py", 2), ("app.py", "app", 3), ("app.py", "requests", 4), ("utils.py", "helpers.py", 1), ("helpers.py", "json", 1)}
    calls = {(s, t, k, n) for s, t, kind, k, n in got if kind == "call"}
    assert {("app.py::main", "utils.format_data", "symbol", 9), ("app.py::main", "to_json", "symbol", 10), ("app.py", "main", "file", 12)} <= calls
    assert ("utils.py::Tool", "to_json", "symbol", 5) in calls  # the first symbol in the list that holds the line is the class
    plain, files = edges.filter("edge_type = 'import'"), files_of(spark, APP).select(F.col("path").alias("file_path"))
    reach = lambda start, depth, way: {(r.node, r.depth) for r in graph.graph_bfs(plain, start, depth, way, files).collect()}
    assert reach("app.py", 1, "upstream") == {("utils.py", 1), ("helpers.py", 1)}
    assert reach("helpers.py", 2, "downstream") == {("app.py", 1), ("utils.py", 1)}
    assert {r.node for r in graph.graph_bfs(plain, "app.py", 1, "upstream").collect()} == {"utils.py", "helpers.py", "app", "requests"}
    stats = graph.graph_stats(edges, files).first()
    assert (stats.files, stats.import_edges, stats.call_edges) == (3, 6, len(calls))


@pytest.mark.parametrize("module, language, suffixes, want", [
    ("a.b", "python", False, "a/b.py"), ("a.c", "python", False, "a/c/__init__.py"), ("./w/x", "javascript", False, "w/x.js"), ("../w/y", "typescript", False, "w/y/index.ts"),
    ("react", "javascript", False, None), ("com.Ex", "java", False, "com/Ex.java"), ("github.com/q/run", "go", False, "run.go"), ("/abs/run", "go", False, None), ("b", "python", False, None),
    ("b", "python", True, "a/b.py"), ("Ex", "java", True, "com/Ex.java"), ("a.b", "python", True, "a/b.py"), ("zz", "python", True, None), ("x", "rust", True, None),
])
def test_resolve_import(spark, module, language, suffixes, want):
    files = spark.createDataFrame([(p,) for p in ("a/b.py", "z/a/b.py", "a/c/__init__.py", "w/x.js", "w/x.ts", "w/y/index.ts", "com/Ex.java", "run.go")], "file_path string")
    imports = spark.createDataFrame([(language, module)] * 3, "language string, module string")
    assert [r.target for r in graph.resolve_import(imports, files, suffixes).collect()] == [want]


def test_broken_files_fall_back(spark):
    """A file with an error gives what line patterns find; one that no parser can follow too; whole files are as parsed."""
    deep = "f" + "()" * 3000
    files = files_of(spark, [
        ("broken.py", "def good():\n    return 1\n\ndef broken(:\n    pass\n"), ("whole.py", "def a():\n    pass\n\n# class Not:\n"), ("deep.py", f"def top():\n    return 1\nx = {deep}\n"),
        ("sum.py", "def s():\n    return 0\ny = " + "+".join(["1"] * 20_000)), ("signs.py", "class C: pass\nz = " + "-" * 20_000 + "1"), ("half.js", "function one() { return 1 }\nfunction two() {\n  return ("),
    ])
    got = {}
    for r in workspace.file_symbols(files).collect():
        got.setdefault(r.path, set()).add((r.name, r.symbol_type, r.start_line))
    assert got["broken.py"] == {("good", "function", 1), ("broken", "function", 4)} and got["whole.py"] == {("a", "function", 1)}
    assert ("top", "function", 1) in got["deep.py"] and ("s", "function", 1) in got["sum.py"] and ("C", "class", 1) in got["signs.py"]
    assert {n for n, *_ in got["half.js"]} == {"one", "two"}


def test_any_bytes_reach_chunks(spark, tmp_path):
    """Truncated and byte-flipped files go from the scan to chunks; the root's name has signs of regular expressions."""
    rnd, root = random.Random(4), tmp_path / "ws(1)+x"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "no.py").write_text("x = 1")
    (root / "src" / "latin.py").write_bytes("def größe():\n    return 'ä'\n".encode("latin-1"))
    for k in range(40):
        raw = bytearray(rnd.choice([APP[0][1], APP[1][1], "class A {\n  int f() { return g(1); }\n}\n", "import x from './x'\nconst b = 1\n"]).encode())
        raw = raw[: rnd.randrange(1, len(raw) + 1)]
        for _ in range(rnd.randrange(4)):
            raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        (root / "src" / f"f{k}.{rnd.choice(['py', 'js', 'java', 'go', 'ts'])}").write_bytes(bytes(raw))
    files = tables.scan_workspace(spark, str(root))
    paths = {r.path for r in files.select("path").collect()}
    assert len(paths) == 41 and all(p.startswith("src/") for p in paths)
    symbols = workspace.file_symbols(files)
    assert parse.chunk_file(files, symbols).count() > 10 and workspace.file_edges(files).count() > 5
    assert "größe" not in {r.name for r in symbols.filter("path = 'src/latin.py'").collect()}


def test_header_chunk(spark):
    """The first run of imports ends at a blank line; variables bring all their lines; the range begins at 1."""
    cases = [
        ("a.py", "# note\nimport os\n\nimport re\n\nX = [\n    1,\n]\n", ("import os\nX = [\n    1,\n]", 1, 8)), ("b.py", "x = 1\n", ("x = 1", 1, 1)), ("c.py", "\n\nimport a\nfrom b import c\n# end\nimport d\n", ("import a\nfrom b import c", 1, 2)),
        ("d.py", "def f():\n    pass\n", None), ("e.py", "y = 0\nimport os\nimport re\n", ("import os\nimport re\ny = 0", 1, 2)),
    ]
    files = files_of(spark, [(p, c) for p, c, _ in cases])
    got = {r.path: (r.content, r.start_line, r.end_line) for r in parse.chunk_header(files, workspace.file_symbols(files)).collect()}
    assert got == {p: w for p, _, w in cases if w}


@pytest.mark.parametrize("line, want", [
    (" M a.py", ("M", "a.py")), ("MM b", ("M", "b")), ("AM c", ("A", "c")), ("?? d e", ("?", "d e")), ("R  old -> new -> er", ("R", "new -> er")), ("T  x", ("?", "x")), ("U  x ", ("U", "x")), (" M", None), ("", None), ("M  ", None),
])
def test_git_status(spark, line, want):
    got = value(spark, logs.git_status_parse(F.lit(line)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("stdout, code, want", [
    ("Tests:       2 failed, 5 passed, 1 skipped, 8 total", 1, (False, 5, 2, 1, 8, 0)), ("Tests: 5 passed, 5 total", 1, (False, 5, 0, 0, 5, 0)), ("Tests: 5 passed, 5 total", 0, (True, 5, 0, 0, 5, 0)),
    ("  ● Suite › adds\n ●\n● Other ›  x \nTests: 2 failed, 5 passed, 7 total", 1, (False, 0, 1, 0, 1, 2)), ("", 0, (True, 0, 0, 0, 0, 0)), ("no such command", 127, (False, 0, 1, 0, 1, 0)),
])
def test_jest(spark, stdout, code, want):
    r = value(spark, logs.parse_jest(F.lit(stdout), F.lit(""), F.lit(code)))
    assert (r.success, r.passed, r.failed, r.skipped, r.total, len(r.failures)) == want
    assert [f.test_name for f in r.failures] == ["Suite › adds", "Other ›  x"][: len(r.failures)]


def test_pytest_lines(spark):
    out = "FAILED a.py::t1 - assert 1 == 2 - twice\nFAILED [ 50%] b.py::t2\nERROR c.py - boom\nERROR d.py\n2 failed, 2 errors in 1s"
    r = value(spark, logs.parse_pytest(F.lit(out), F.lit(""), F.lit(1)))
    assert [(f.test_name, f.error) for f in r.failures] == [("a.py::t1", "assert 1 == 2 - twice"), ("b.py::t2", "assertion failed"), ("c.py", "boom"), ("d.py", "test error")]


def test_smaller_rules(spark):
    assert [value(spark, X.is_test_file(F.lit(p))) for p in ("a/test", "tests", "a/tests/x.py", "latest", "a/test_x.py", "contest/x.py")] == [True, True, True, False, True, False]
    long = "".join(str(k % 10) for k in range(9000))
    assert value(spark, X.truncate_two_thirds(F.lit(long))) == long[:5333] + "\n... [diff truncated: 1000 chars omitted] ...\n" + long[-2607:]
    assert value(spark, X.truncate_two_thirds(F.lit(long[:8000]))) == long[:8000]
    rows = [("c", k, kind, "x" * 400) for k, kind in enumerate(("implicit", "selection", "file"))]
    items = spark.createDataFrame(rows, "conv string, ord int, type string, content string")
    assert {r.type for r in context.context_truncate(items, 100).collect()} == {"file"}
    assert {r.type: len(r.content) for r in context.context_truncate(items, 250).collect()} == {"file": 400, "selection": 400, "implicit": 180}
    inline = spark.createDataFrame([("c", 9, "a.py", 5, 5, "one"), ("c", 8, "s.py", 5, 9, "has"), ("d", 7, "s.py", 3, 1, "up")], "conv string, ord int, file_path string, start int, end int, text string")
    held = spark.createDataFrame([("c", 1, "selection", "s.py", "t"), ("c", 2, "file", "a.py", "u")], "conv string, ord int, type string, file_path string, content string")
    got = {(r.conv, r.type, r.file_path, r.content) for r in context.inline_annotate(held, inline).collect()}
    assert got == {("c", "selection", "s.py", "t"), ("c", "file", "a.py", "u"), ("c", "selection", "a.py", "[行 5-5，共 1 行]\none"), ("d", "selection", "s.py", "[行 3-1，共 1 行]\nup")}
    say = lambda *a: value(spark, logs.test_summary(*map(F.lit, a)))
    assert say(True, False, "after 60s", 0, 0, 1, 0) == "测试超时中止（after 60s）" and say(False, True, None, 3, 0, 0, 0) == "测试全部通过 ✅ (3 passed)"
    assert say(False, False, "", 1, 2, 3, 4) == "测试存在失败 ❌ (1 passed, 2 failed, 3 errors, 4 skipped)"


def on_cycles(edges):
    reach = {}
    for plan, a, b in edges:
        reach.setdefault((plan, a), set()).add(b)
    grown = True
    while grown:
        grown = False
        for (plan, _), to in reach.items():
            more = set().union(*(reach.get((plan, x), set()) for x in to)) - to
            to |= more
            grown |= bool(more)
    return {k for k, to in reach.items() if k[1] in to}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_any_graph(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"p{p}", a, b) for p in range(6) for a, b in ((rnd.randrange(14), rnd.randrange(14)) for _ in range(rnd.choice([8, 14, 20]))) if a != b}
    got = {tuple(r) for r in graph.cycles(spark.createDataFrame(sorted(edges), "plan string, id int, dep int")).collect()}
    assert got == on_cycles(edges)


def test_long_cycle(spark):
    """20,000 steps in a ring, with a tail into it: rows stay linear, rounds logarithmic."""
    n = 20_000
    ring = spark.range(n).selectExpr("'r' AS plan", "id", f"array((id + 1) % {n}) AS deps").unionByName(spark.range(n, n + 50).selectExpr("'r' AS plan", "id", "array(id - 1) AS deps"))
    assert graph.dag_validate(ring).groupBy("violation").count().collect() == [("cycle", n)]


def test_enclosing_symbol(spark):
    rnd = random.Random(8)
    spans = [(f"f{k % 3}", a, a + rnd.randrange(30), k, f"s{k}") for k, a in ((k, rnd.randrange(200)) for k in range(150))]
    points = [(f"f{k % 4}", rnd.randrange(240)) for k in range(300)]
    frame = spark.createDataFrame([*spans, ("f0", 1, None, 0, "n"), (None, 1, 2, 0, "n")], "file string, start_line int, end_line int, ord int, name string")
    got = {(r.file, r.line): r.symbol for r in graph.enclosing_symbol(spark.createDataFrame([*points, ("f1", None)], "file string, line int"), frame).collect()}
    want = {}
    for f, line in points:
        holds = [(o, n) for g, a, b, o, n in spans if g == f and a <= line <= b]
        if holds:
            want[f, line] = min(holds)[1]
    assert got == want
    hot = spark.range(100_000).selectExpr("'h' AS file", "id AS start_line", "200000 - id AS end_line", "id AS ord", "concat('s', id) AS name")
    lines = spark.range(100_000).selectExpr("'h' AS file", "id * 2 AS line")
    assert graph.enclosing_symbol(lines, hot).groupBy("symbol").count().collect() == [("s0", 100_000)]


def test_modules_are_read_once_and_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "REFERENCES", 400, raising=False)
    files = spark.range(2000).select(F.format_string("a%d.py", "id").alias("path"), F.format_string("import a%d, b%d", F.col("id") + 1, "id").alias("content"), F.lit("python").alias("language"))
    modules = workspace.read_imports(files).select(F.lit("python").alias("language"), "module")
    got = graph.resolve_import(modules, files.select(F.col("path").alias("file_path")))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    assert got.rdd.getNumPartitions() == 40
    want = {f"a{k + 1}": f"a{k + 1}.py" if k < 1999 else None for k in range(2000)} | {f"b{k}": None for k in range(2000)}
    assert {r.module: r.target for r in got.collect()} == want


def test_edges_are_dealt_by_the_number_of_references(spark, monkeypatch):
    monkeypatch.setattr(graph, "REFERENCES", 100, raising=False)
    refs = spark.range(3000).select(F.format_string("a%d.py", F.col("id") % 50).alias("path"), F.col("id").cast("int").alias("ord"), F.lit("call").alias("kind"), F.format_string("t%d", "id").alias("target"), F.when(F.col("id") > 0, (F.col("id") % 5).cast("int")).alias("line"))
    spans = spark.createDataFrame([(f"a{k}.py", 0, "f", 2, 3) for k in range(50)], "path string, ord int, name string, start_line int, end_line int")
    got = graph.build_edges(refs, spans, spans.select(F.col("path").alias("file_path")))
    assert max(got.rdd.glom().map(len).collect()) < 200
    held = lambda k: k and k % 5 in (2, 3)
    want = sorted((f"a{k % 50}.py" + "::f" * bool(held(k)), f"t{k}", "call", "symbol" if held(k) else "file", k % 5 if k else None, f"t{k}") for k in range(3000))
    assert sorted(map(tuple, got.collect())) == want
