"""Work on files is spread over all cores, and stays with each file where it can."""

import ast

import pytest
from pyspark.sql import functions as F

from cairn.operators import braces, parse, search, workspace
from cairn.plans import code, service
from cairn.sources import scratch
from cairn.sources.scratch import spread


def test_files_of_a_table_of_one_row_group_are_parsed_by_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id AS p_partkey", "id AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parsed = parse.parse_symbols_py(code._files(spark, str(tmp_path)).filter("language = 'python'"))
    assert parsed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r.path for r in parsed.collect()} == {f"p{k}/app.py" for k in range(100)}


def test_line_patterns_need_no_shuffle(spark):
    files = spark.createDataFrame([("a.js", "let a = 1\nvar b\nfunction f() {\n let c = 2\n}\n\nclass G {\n}\n"), ("b.js", "const d = 1"), ("c.js", None), ("d.js", "x\n")], "path string, content string")
    found = parse.fallback_symbols(files)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [
        ("a.js", "G", "class", 7, 8), ("a.js", "a", "variable", 1, 1), ("a.js", "f", "function", 3, 6), ("b.js", "d", "variable", 1, 1),
    ]


def test_a_source_is_scanned_once(monkeypatch):
    made = []
    monkeypatch.setattr(braces, "Source", lambda *a, real=braces.Source: made.append(1) or real(*a))
    rows = braces.rows("a.js", "import x from 'y'\nfunction f() { g() }", "javascript")
    assert [r[2:4] for r in rows] == [("function", "f"), ("import", "y"), ("call", "g")] and len(made) == 1


@pytest.mark.parametrize("source", [
    "True.real()\n1()\n'x'.join(a)\na().b()\n(lambda: f())()\na[g()].h()\n", "_()\n__._()\né.b(x)\n", "a = b = 1; c: int = f(2)\nif x:\n    def g(): pass\n    y = 1\n",
    "try:\n  def a(): pass\nexcept E(1):\n  import q\nelse:\n  class C: pass\nfinally:\n  def d(x=[f(i) for i in g()]): from .. import y\n", "match x:\n  case A(b=1) if h():\n    import z, w.v\n",
    "@dec(1)\n@o.p\nasync def w(*, a=q(), **k) -> r(): await s()\n", "from . import x\nfrom .a.b import c\n", "f'{u(1)!r:>{v(2)}}'\nNone()\n",
])
def test_one_walk_gives_what_the_parser_sees(source):
    tree = ast.parse(source)
    calls = sorted((n.lineno, ast.unparse(n.func)) for n in ast.walk(tree) if isinstance(n, ast.Call) and ast.unparse(n.func).replace(".", "").replace("_", "").isalnum())
    names = [n.name for n in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))), key=lambda n: n.lineno)]
    rows = parse.python_rows("p", source)
    assert [(r[4], r[3]) for r in rows if r[2] == "call"] == calls
    assert [r[3] for r in rows if r[2] in ("function", "class")] == names
    assert sorted(r[3:5] for r in rows if r[2] == "import") == sorted(r[1:] for r in parse.python_imports("p", source))


def test_imports_alone_are_those_of_all_references(spark):
    files = code._files(spark, "/root/testdata/sf0.001").limit(40)
    want = workspace.references_of(workspace.read_files(files)).filter("kind = 'import'").select("path", "target", "line")
    assert sorted(map(tuple, workspace.read_imports(files).collect())) == sorted(map(tuple, want.collect()))




def test_documents_of_one_row_group_are_indexed_by_all_cores(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id AS doc_id", "'zebra quokka' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(search, "write_bm25", lambda docs, *a, real=search.write_bm25: seen.append(docs.rdd.getNumPartitions()) or real(docs, *a))
    assert {(r.term, r.df) for r in service.sink_bm25(spark, str(tmp_path)).collect()} == {("zebra", 100), ("quokka", 100)}
    assert seen == [spark.sparkContext.defaultParallelism]


def test_a_row_group_in_a_file_of_many_cuts_is_spread_by_its_rows(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        held = [n for n in spread(rows, 1000).rdd.glom().map(len).collect() if n]
        assert len(held) == 20 and max(held) < 2000 and sum(held) == 20_000
        even = spark.range(20_000, numPartitions=40)
        assert spread(even, 1000).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


@pytest.mark.parametrize(("path", "language"), [(p, language) for p, language, _ in code.SOURCES])
def test_symbols_alone_are_those_of_a_whole_reading(spark, path, language):
    source = next("\n".join(lines) for p, _, lines in code.SOURCES if p == path)
    sources = [source, "try:\n  def a(): pass\nexcept E:\n  x = 1\nelse:\n  class C:\n    y = 2\nfinally:\n  async def d(): pass\nmatch x:\n  case 1:\n    @o\n    def e(): pass\nb: int = 3\n", "class (", ""]
    files = spark.createDataFrame([(f"f{k}", x, language) for k, x in enumerate(sources)], "path string, content string, language string")
    want = workspace.read_files(files).filter("kind not in ('import', 'call')")
    assert sorted(map(tuple, workspace.read_files(files, references=False).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("chunk", [parse.chunk_symbol, parse.chunk_split_ast])
def test_texts_made_within_a_plan_are_not_broadcast(spark, tmp_path, chunk):
    spark.range(2000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.range(3_000_000).select(F.concat(F.lit("p"), "id", F.lit("/app.py")).alias("path"), F.lit("f").alias("name"), F.lit("function").alias("symbol_type"), F.lit(1).alias("start_line"), F.lit(300).alias("end_line"))
    plan = chunk(code._files(spark, str(tmp_path)), rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_files_of_orders_are_dealt_by_the_number_of_items(spark, tmp_path, monkeypatch):
    spark.range(9000).selectExpr("id div 3 AS l_orderkey", "id AS l_partkey", "cast(id % 3 AS int) AS l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(service, "spread_by", lambda df, key: scratch.spread_by(df, key, 300), raising=False)
    held = [n for n in service._workspace(spark, str(tmp_path)).rdd.glom().map(len).collect() if n]
    assert sum(held) == 3001 and max(held) < 300
