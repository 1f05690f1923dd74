"""Worked examples, and brute-force versions of what SQL cannot express."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import context, graph, logs, parse, plans, search, session
import cases as fixtures
from cairn.sources import stores, tables
from cairn.sources.scratch import scratch
from cairn.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("QuickSort", ["quick", "sort"]), ("quick_sort", ["quick", "sort"]), ("HTTPServer", ["http", "server"]), ("sortData 排序法", ["sort", "data", "排序", "序法"]), (None, []), ("the a I", [])])
def test_tokenize(spark, text, want):
    assert value(spark, X.tokenize(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("path", "want"), [("a/test_x.py", True), ("tests/x.py", True), ("contest_123.py", False), ("x_test.go", True), ("a.test.js", True), ("latest/x.py", False)])
def test_is_test_file(spark, path, want):
    assert value(spark, X.is_test_file(F.lit(path))) is want


def test_paths_and_predicates(spark):
    assert value(spark, X.norm_path(F.lit(".\\a//b/./c/"))) == "a/b/c"
    assert value(spark, X.workspace_relative(F.lit("/w/a/../b/c.py"), "/w")) == "b/c.py"
    assert value(spark, X.workspace_relative(F.lit("../x"), "/w")) is None and value(spark, X.workspace_relative(F.lit("x/y"), "/w/")) == "x/y"
    assert value(spark, X.detect_language(F.lit("A.TSX"))) == "typescript" and value(spark, X.detect_language(F.lit("x.rs"))) == "unknown" and value(spark, X.detect_language_ext(F.lit("x.rs"))) == "rust"
    assert value(spark, X.normalize_query(F.lit("  How   TO sort？！ "))) == "how to sort"
    assert value(spark, X.is_danger_cmd(F.lit("sudo ls"))) and not value(spark, X.is_danger_cmd(F.lit("ls")))
    for cmd, want in (("npm init", True), ("npm init -y", False), ("python3", True), ("python3 a.py", False), ("ssh host", True), ("ssh -T host", False)):
        assert value(spark, X.is_interactive_cmd(F.lit(cmd))) is want, cmd
    assert value(spark, X.symbol_tokens(F.lit("who calls #Data.x getUser and getUser"))) == ["Data", "getUser"]
    assert value(spark, X.json_greedy(F.lit('```json\n{"a": 1}\n``` ok'))) == '{"a": 1}' and value(spark, X.json_greedy(F.lit("{no"))) is None
    assert value(spark, X.match_call_target(F.lit("a.Save"), F.lit("save"))) and not value(spark, X.match_call_target(F.lit("unsave"), F.lit("save")))


def test_rrf_example(spark):
    ranked = spark.createDataFrame([(0, "vector", "a", 1), (0, "vector", "b", 2), (1, "bm25", "a", 1), (1, "bm25", "c", 2), (2, "symbol", "a", 1)], "path_ord int, path string, id string, rank int")
    rows = search.rrf_fuse(ranked).collect()
    assert rows[0].id == "a" and rows[0].rrf_score == pytest.approx(3 / 61) and rows[0].sources == ["vector", "bm25", "symbol"]
    assert [r.id for r in rows] == ["a", "b", "c"]


def test_bm25_prefers_matches(spark):
    docs = spark.createDataFrame([(1, "quick sort of numbers"), (2, "bubble sort"), (3, "http client"), (4, None), (5, "other words entirely here")], "id long, text string")
    index = search.write_bm25(docs, scratch(spark, "bm25"), "id", "text")
    rows = search.bm25_topk(index, ["quick", "sort"], 3).collect()
    assert [r.id for r in rows][:2] == [1, 2] and rows[2].score == 0
    assert search.bm25_topk(index, ["quick"], 3, drop_zero=True).count() == 1


def test_error_parsers(spark):
    df = spark.createDataFrame(fixtures.LOGS, "id string, raw string, cwd string").select("id", logs.parse_error(F.col("raw"), F.col("cwd")).alias("e"))
    got = {r.id: r.e for r in df.collect()}
    assert (got["py"].error_type, got["py"].file_path, got["py"].line, got["py"].code_snippet) == ("NameError", "pkg/main.py", 5, "go()\nx = y")
    assert (got["js"].file_path, got["js"].line, got["js"].col, got["js"].language) == ("src/app.ts", 12, 7, "typescript")
    assert (got["gcc"].file_path, got["gcc"].line, got["gcc"].col, got["gcc"].parse_strategy) == ("main.c", 10, 5, "gcc_compiler")
    assert (got["tsc"].error_message, got["tsc"].parse_strategy) == ("Cannot find module 'foo'", "ts_compiler")
    assert (got["rust"].error_type, got["rust"].file_path) == ("RustErrorE0425", "src/main.rs")
    assert (got["pytest"].error_type, got["pytest"].parse_strategy) == ("AssertionError", "pytest_error")
    assert (got["direct"].file_path, got["direct"].line) == ("calc.py", 42)
    assert got["npm"].error_message == "npm ERR! failed to build" and got["blank"].parse_strategy == "fallback"


def test_reports(spark):
    df = spark.createDataFrame(fixtures.REPORTS, "id string, stdout string, code int")
    got = {r.id: r for r in df.select("id", logs.parse_pytest(F.col("stdout"), F.lit(None).cast("string"), F.col("code")).alias("p"), logs.parse_jest(F.col("stdout"), F.lit(""), F.col("code")).alias("j")).collect()}
    assert got["ok"].p.success and got["ok"].p.total == 3
    bad = got["bad"].p
    assert (bad.passed, bad.failed, bad.errors, bad.skipped, bad.success) == (2, 1, 1, 1, False)
    assert [(f.test_name, f.error) for f in bad.failures] == [("t/test_a.py::test_x", "assert 3 == 4"), ("t/test_b.py", "test error")]
    assert (got["jest"].j.passed, got["jest"].j.failed, got["none"].j.failed) == (0, 1, 1)


def test_json_and_diff(spark):
    text = 'x {"a": "}", "b": [1,2,],} {"c": 1}'
    assert json.loads(value(spark, logs.json_first_object(F.lit(text)))) == {"a": "}", "b": [1, 2]}
    diff = value(spark, logs.unified_diff(F.lit("f"), F.lit("a\nb\n"), F.lit("a\nc\n"), F.lit(3)))
    assert "-b" in diff and "+c" in diff and value(spark, logs.unified_diff(F.lit("f"), F.lit("a"), F.lit("a"), F.lit(3))) == ""
    assert tuple(value(spark, logs.git_status_parse(F.lit("R  a.py -> b.py")))) == ("R", "b.py")


def test_python_symbols_and_chunks(spark):
    files = spark.createDataFrame(fixtures.FILES, "path string, content string")
    symbols = parse.parse_symbols_py(files.filter("path like '%.py'"))
    app = [(r.name, r.symbol_type, r.start_line, r.end_line) for r in symbols.filter("path = 'app.py'").orderBy("ord").collect()]
    assert app == [("LIMIT", "variable", 4, 4), ("Shop", "class", 7, 9), ("sell", "function", 8, 9), ("main", "function", 12, 14)]
    js = [(r.name, r.symbol_type, r.start_line, r.end_line) for r in parse.fallback_symbols(files.filter("path like '%.js'")).orderBy("start_line").collect()]
    assert js == [("b", "variable", 2, 2), ("show", "function", 4, 7), ("View", "class", 8, 9)]
    chunks = {r.symbol_name: r for r in parse.chunk_file(files, symbols).filter("path = 'app.py'").collect()}
    assert chunks["__header__"].content.startswith("import os\nfrom utils import tidy") and "LIMIT = 3" in chunks["__header__"].content
    assert chunks["main"].content.startswith("main | def main():\n@cache")
    calls = {r.target for r in parse.extract_edges_py(files.filter("path = 'app.py'")).filter("kind = 'call'").collect()}
    assert "tidy" in calls and {r.module for r in parse.extract_imports(files).collect()} >= {"os", "utils", "./a", "re"}


def test_merge_small_blocks(spark):
    def model(sizes):
        out, held = [], 0
        for n in sizes:
            if n >= 40:
                out += [held] * (held > 0) + [n]
                held = 0
            elif (held := held + n) >= 40:
                out, held = [*out, held], 0
        if held:
            out = [*out[:-1], out[-1] + held] if out else [held]
        return out

    rng = random.Random(4)
    cases = [[rng.randint(1, 60) for _ in range(rng.randint(1, 9))] for _ in range(40)] + [[50], [3]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, sizes array<int>").select("k", parse.merge_small_blocks(F.col("sizes")).alias("m")).collect()
    assert {r.k: r.m for r in rows} == {k: model(c) for k, c in enumerate(cases)}


def limit_model(times, per_minute, per_day):
    minute, day, out = [], [], []
    for t in sorted(times):
        minute, day = [x for x in minute if x > t - 60], [x for x in day if x > t - 86400]
        a, b = len(minute) < per_minute, len(day) < per_day
        minute += [t] * a
        day += [t] * (a and b)
        out.append(a and b)
    return out


def test_rate_limit(spark):
    rng = random.Random(1)
    users = {u: [round(rng.random() * 400, 2) for _ in range(40)] for u in range(5)}
    df = spark.createDataFrame([(u, t) for u, ts in users.items() for t in ts], "u int, t double")
    got = {}
    for r in session.rate_limit(df, "u", "t", 4, 15).orderBy("u", "n").collect():
        got.setdefault(r.u, []).append(r.accepted)
    assert got == {u: limit_model(ts, 4, 15) for u, ts in users.items()}
    burst = session.rate_limit(spark.range(30).select(F.lit(1).alias("u"), (F.col("id") / 30).alias("t")), "u", "t")
    assert burst.filter("accepted").count() == 20


def test_session_trim_keeps_system_and_fits(spark):
    rows = [("s", 0, "system", "be brief")] + [("s", k, ["user", "assistant"][k % 2], "m" * 500) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "s string, k int, role string, text string")
    kept = session.session_trim(df, "s", "k", rounds=5, budget=8000).collect()
    assert len(kept) == 11 and {r.role for r in kept} >= {"system"} and min(r.k for r in kept if r.k) == 31
    small = session.session_trim(df, "s", "k", rounds=20, budget=400).agg(F.sum(F.length("text"))).first()[0]
    assert small // 4 <= 360


def test_context(spark):
    body = "\n".join(f"    x{k} = {k}" for k in range(150))
    code = f'# top\ndef f(a):\n    """Doc\n    more\n    """\n    # note\n{body}'
    out = value(spark, context.compress_chunk(F.lit(code), F.lit("function"), F.lit("python"))).split("\n")
    assert out[:5] == ["def f(a):", '    """Doc', "    more", '    """', "    # note"] and len(out) == 5 + 10 + 1 + 10 and "省略 130 行" in out[15]
    assert value(spark, context.compress_chunk(F.lit("def f(): pass"), F.lit("function"), F.lit("python"))) == "def f(): pass"
    items = spark.createDataFrame([("a/B.py", 0.5), ("c.py", 0.6)], "file_path string, score double")
    assert {r.file_path: round(r.position_score, 6) for r in context.position_boost(items, "A\\b.py").collect()} == {"a/B.py": 0.65, "c.py": 0.6}


def test_graph(spark):
    edges = spark.createDataFrame([("app.py", "utils.py"), ("app.py", "helpers.py"), ("utils.py", "helpers.py"), ("helpers.py", "app.py")], "source string, target string")
    assert {(r.node, r.depth) for r in graph.graph_bfs(edges, "app.py", 5, "upstream").collect()} == {("utils.py", 1), ("helpers.py", 1)}
    assert {(r.node, r.depth) for r in graph.graph_bfs(edges, "utils.py", 1).collect()} == {("app.py", 1)}
    steps = spark.createDataFrame([("p", "a", 0, "done", []), ("p", "b", 1, "pending", ["a"]), ("p", "c", 2, "pending", ["b"]), ("q", "a", 0, "pending", ["b"]), ("q", "b", 1, "pending", ["a"]), ("q", "c", 2, "pending", ["c", "z"])], "plan string, id string, ord int, status string, deps array<string>")
    assert {(r.plan, r.id, r.violation) for r in graph.dag_validate(steps).collect()} == {("q", "a", "cycle"), ("q", "b", "cycle"), ("q", "c", "self"), ("q", "c", "missing")}
    assert {(r.plan, r.id) for r in graph.dag_runnable(steps).collect()} == {("p", "b")}


def test_sources(spark, tmp_path):
    root = tmp_path / "ws"
    for p, text in (("main.py", "x = 1\n"), ("lib/helper.js", "let a = 1\n"), ("node_modules/i.js", "no"), ("big.py", "#" * (1 << 20) + "#"), ("notes.txt", "no")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    got = {(r.path, r.language, r.content) for r in tables.scan_workspace(spark, str(root)).collect()}
    assert got == {("main.py", "python", "x = 1\n"), ("lib/helper.js", "javascript", "let a = 1\n")}
    with pytest.raises(ValueError):
        tables.scan_workspace(spark, str(tmp_path / "absent"))
    calls = spark.createDataFrame([(1.0, "s", "grep", True, 2.0, "y" * 600)], "ts double, session_id string, tool_name string, success boolean, duration_ms double, output string")
    tables.write_audit(calls, str(tmp_path / "audit"))
    assert tables.read_audit(spark, str(tmp_path / "audit")).first().output_preview.endswith("(total 600 chars)")
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "frag"))
    assert tuple(tables.compact(spark, str(tmp_path / "frag"), str(tmp_path / "one"), 1).first()) == (8, 1)
    texts = spark.createDataFrame([("a",), ("b",)], "content string")
    cache = spark.createDataFrame([("m1", "a")], "model string, c string").select(F.sha2("c", 256).alias("content_hash"), "model", F.array(F.lit(1.0)).alias("embedding"))
    hits, misses = tables.cache_embed(texts, cache, "m1")
    assert [r.content for r in hits.collect()] == ["a"] and [r.content for r in misses.collect()] == ["b"]
    order = tables.reorder_priority(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, n int"), ["c", "c", "zz"], "n").orderBy("place")
    assert [r.path for r in order.collect()] == ["c", "a", "b"]


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, round(rng.random() * 300, 2)) for u in range(4) for _ in range(25)]
    spark.createDataFrame(rows, "user_id long, t double").coalesce(1).write.parquet(str(tmp_path / "req"))
    stream = jobs.rate_limit_stream(spark.readStream.schema("user_id long, t double").parquet(str(tmp_path / "req")), 4, 12)
    stream.writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    got = sorted(map(tuple, spark.table("limited").collect()))
    want = sorted((u, t, ok) for u in range(4) for t, ok in zip(sorted(t for x, t in rows if x == u), limit_model([t for x, t in rows if x == u], 4, 12)))
    assert got == want
    changes = [[("a", 1, "put", "1"), ("b", 2, "put", "1")], [("a", 3, "put", "2"), ("b", 4, "delete", None), ("c", 5, "put", "x"), ("c", 6, "put", "y")]]
    for k, batch in enumerate(changes):
        spark.createDataFrame(batch, "path string, seq long, action string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "chg"))
        jobs.incremental_index(spark.readStream.schema("path string, seq long, action string, content string").parquet(str(tmp_path / "chg")), str(tmp_path / "idx"), str(tmp_path / "ck2")).awaitTermination()
    assert {tuple(r) for r in jobs.read_index(spark, str(tmp_path / "idx")).collect()} == {("a", "2"), ("c", "y")}
    jobs.compact_index(spark, str(tmp_path / "idx"), str(tmp_path / "small"))
    assert {tuple(r) for r in jobs.read_index(spark, str(tmp_path / "small")).collect()} == {("a", "2"), ("c", "y")}


def test_interval_join_of_streams(spark, tmp_path):
    rng = random.Random(7)
    rows = {name: [(rng.choice("aab"), k, rng.randrange(400)) for k in range(80)] for name in ("click_id", "edit_id")}
    streams = {}
    for name, own in rows.items():
        schema = f"who string, {name} int, at timestamp"
        frame = spark.createDataFrame(own, f"who string, {name} int, s int").select("who", name, F.timestamp_seconds("s").alias("at"))
        frame.coalesce(1).write.parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    joined = jobs.click_then_edit_stream(streams["click_id"], streams["edit_id"], "who", 30)
    joined.writeStream.format("memory").queryName("cues").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    want = sorted((a[1], b[1]) for a in rows["click_id"] for b in rows["edit_id"] if a[0] == b[0] and 0 < b[2] - a[2] <= 30)
    assert sorted((r.click_id, r.edit_id) for r in spark.table("cues").collect()) == want and want


def test_cells_find_most_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<float>, label int").repartition(4)
    centres = search.write_ivf(df, str(tmp_path / "ivf"), "id", "v", 30)
    index = spark.read.parquet(str(tmp_path / "ivf"))
    assert index.count() == 3000
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("q"), "v")
    got = {}
    for r in search.ivf_search(index, centres, queries, 10, "id", "v", 8).collect():
        got.setdefault(r.q, set()).add(r.id)
    far = ((x[:, None, :].astype("f8") - x[None, ::20, :]) ** 2).sum(2)
    exact = {20 * k: set(np.lexsort((np.arange(3000), far[:, k]))[:10].tolist()) for k in range(150)}
    recall = np.mean([len(got[q] & exact[q]) / 10 for q in exact])
    assert recall >= 0.9
    some = search.ivf_topk(index, centres, x[0].tolist(), 5, "id", "v", 8, where=F.col("label") == 1)
    assert all(r.id % 3 == 1 for r in some.collect()) and some.count() == 5
    assert "PartitionFilters: [cell#" in some._jdf.queryExecution().executedPlan().toString()


def test_plan_convert_and_checks(spark):
    good = [{"id": f"s{k}", "description": f"d{k}", "dependencies": [f"s{k - 1}"] if k else [], "suggested_tool": "ask_user"} for k in range(5)]
    cyclic = [{**s, "dependencies": ["s4"]} if k == 0 else s for k, s in enumerate(good)]
    rows = [("good", json.dumps({"plan": good})), ("bare", json.dumps(good)), ("cycle", json.dumps({"plan": cyclic})), ("none", "{}"), ("cut", '{"plan": ['), ("odd", json.dumps({"plan": [{"description": " x ", "dependencies": "s1", "suggested_tool": "fly"}, {"id": "", "description": ""}]})), ("null", None)]
    raw = spark.createDataFrame(rows, "plan string, raw string")
    bad = sorted((r.plan, r.violation) for r in plans.plan_merge_checks(raw).collect())
    assert bad == [("cut", "json"), ("cycle", "cycle"), ("none", "plan"), ("null", "json"), ("odd", "count"), ("odd", "description")]
    odd = [tuple(r)[1:] for r in plans.plan_convert(raw).filter("plan = 'odd'").orderBy("ord").collect()]
    assert odd == [(0, "step_1", "x", "x", [], ""), (1, "step_2", "", "", [], "")]
    assert plans.plan_convert(raw).filter("plan = 'bare'").count() == 5


def test_confirm_store(spark):
    issued = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "token string, issued_at int")
    looked = spark.createDataFrame([("a", 1, 10, "get"), ("a", 2, 20, "pop"), ("a", 3, 30, "pop"), ("b", 1, 900, "pop"), ("c", 1, 301, "get"), ("c", 2, 302, "pop"), ("z", 1, 1, "get")], "token string, ord int, at int, kind string")
    found = {(r.token, r.ord): r.found for r in session.confirm_store(issued, looked).collect()}
    assert found == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("c", 1): False, ("c", 2): False, ("z", 1): False}


def test_retrieval_cache_against_a_plain_cache(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), float(rng.randrange(5000))) for _ in range(800)]
    seen, want = {}, []
    for k, at in sorted(rows):
        hit = k in seen and at - seen[k] <= 300
        if not hit:
            seen[k] = at
        want.append((k, at, hit))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(tuple(r) for r in session.retrieval_cache(spark.createDataFrame(rows, "key string, at double")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)


def test_long_functions_split_at_statements(spark):
    path, source = fixtures.LONG_FILE
    files = spark.createDataFrame([(path, source), ("bad.py", "x = 1\n")], "path string, content string")
    cut = parse.chunk_split_ast(files, parse.parse_symbols_py(files)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in cut][0][0] == 1 and cut[-1].end_line == len(source.splitlines())
    assert len(cut) == 10 and all(a.end_line + 1 == b.start_line for a, b in zip(cut, cut[1:], strict=False))
    assert all(r.content.startswith("big | def big(n):\n") for r in cut) and "n > 0" in cut[1].content
    unreadable = spark.createDataFrame([(path, "def f(:\n" + "x\n" * 400)], "path string, content string")
    known = spark.createDataFrame([(path, "f", "function", 1, 401)], "path string, name string, symbol_type string, start_line int, end_line int")
    assert [(r.start_line, r.end_line) for r in parse.chunk_split_ast(unreadable, known).orderBy("start_line").collect()] == [(1, 150), (151, 300), (301, 401)]
    assert parse.chunk_file(files, parse.parse_symbols_py(files)).filter("symbol_name = 'big'").count() == 10


def test_framework_results_and_diffs(spark):
    tests_ = spark.createDataFrame([("a", "javascript"), ("b", "python"), ("c", "javascript"), ("d", "python")], "project string, kind string")
    projects = spark.createDataFrame([("a", '{"scripts": {"test": "x"}}'), ("b", None), ("c", "{cut"), ("d", '{"dependencies": {"jest": "1"}}'), ("e", None)], "project string, package string")
    assert {r.project: r.framework for r in logs.detect_framework(tests_, projects).collect()} == {"a": "npm_test", "b": "pytest", "c": "jest", "d": "jest", "e": "unknown"}
    now = spark.createDataFrame([("a", "1\n"), ("b", "same\n")], "path string, content string")
    new = spark.createDataFrame([("a", "2\n"), ("b", "same\n"), ("c", "new\n"), (None, "x"), ("d", None)], "path string, content string")
    diffs = {r.path: r.diff for r in logs.build_diff_files(new, now).collect()}
    assert set(diffs) == {"a", "b", "c"} and diffs["b"] == "" and "-1\n+2" in diffs["a"] and "+new" in diffs["c"]
    assert value(spark, X.filter_recent(F.lit(5.0), F.lit(100 * 86400.0), 3)) is False and value(spark, X.filter_recent(F.lit(None).cast("double"), F.lit(1.0), 3)) is True
    assert value(spark, X.filter_recent(F.lit(5.0), F.lit(1e12), 0)) is True and value(spark, X.project_status(F.lit(0), F.lit(0))) == 0.0


def test_clicks_and_edits_against_every_pair(spark):
    rng = random.Random(5)
    clicks = [(rng.choice("aaab"), k, rng.randrange(500)) for k in range(120)]
    edits = [(rng.choice("aaab"), k, rng.randrange(500)) for k in range(120)]
    got = stores.click_then_edit(spark.createDataFrame(clicks, "k string, click_id int, at int"), spark.createDataFrame(edits, "k string, edit_id int, at int"), "k", 30)
    want = sorted((a[1], b[1]) for a in clicks for b in edits if a[0] == b[0] and 0 < b[2] - a[2] <= 30)
    assert sorted((r.click_id, r.edit_id) for r in got.collect()) == want


def test_bm25_without_tokens(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None), (4, "blue blue")], "i int, t string")
    assert [r.id for r in search.bm25_topk(search.write_bm25(docs, scratch(spark, "bm25"), "i", "t"), ["fox"], 5).collect()] == [1, 4]
    assert search.bm25_topk(search.write_bm25(docs.limit(0), scratch(spark, "bm25"), "i", "t"), ["fox"], 5).collect() == []


def test_workspace_relative_of_all_pages(spark, tmp_path):
    import posixpath
    import re

    from cairn.plans import service  # noqa: F401 - adds to the queries
    from cairn.plans.bindings import QUERIES

    urls = ["https://h/a/b.html", "http://h/a/b.html", "https://h/a/b/c/d.html?x=1#y", "https://h/", "https://h/../../etc/x", "https://h/a/./b//c.d/", "https://h/a/../..", "https://h", "x/y", "https://h/?q=../z"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def rel(path):
        full = posixpath.normpath(posixpath.join("/w", path))
        return "." if full == "/w" else full[3:] if full.startswith("/w/") else None

    def want(i, url):
        path = re.sub("^[a-z]+://[^/]*/", "/w/x/../", url)
        return i, rel(path), url.startswith("https://") and rel(path) is not None

    assert sorted(map(tuple, QUERIES["workspace_relative"](spark, str(tmp_path)).collect())) == [want(i, u) for i, u in enumerate(urls)]


def test_bm25_reads_only_its_terms(spark):
    docs = spark.range(300).selectExpr("id", "concat('alpha', cast(id as string), ' beta', cast(id % 7 as string)) as text")
    path = scratch(spark, "bm25")
    search.write_bm25(docs, path, "id", "text")
    index = search.read_bm25(spark, path)
    plan = search.bm25_scores(index, ["beta3"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*term,\s*\[?beta3", plan), plan
    assert search.bm25_scores(index, ["beta3"]).count() == 43


def test_bm25_skips_blocks(spark):
    """The k best are those of a search that reads every block, also among equal scores and with documents of score 0; a rare term
    leaves most blocks of a frequent one unread."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["the", "of", "rare", "fox", "sea", f"w{k}"], [60, 30, 0.15, 1, 2, 3], k=rng.choice([5, 40, 41])))) for k in range(6000)]
    index = search.write_bm25(spark.createDataFrame(rows, "id long, text string").repartition(6), scratch(spark, "bm25"), "id", "text")
    held = {r.id for r in index.lengths.collect()}  # documents of stop words alone have no place
    size = index.blocks.filter("term = 'fox'").selectExpr("sum(size(ids))").first()[0]
    assert size == sum("fox" in x.split() for _, x in rows) and index.terms.filter("term = 'fox'").first().df == size
    for query, k in ((["rare", "fox"], 10), (["fox", "sea", "sea"], 5), (["w17", "none"], 20), (["sea"], 1), (["none"], 4), ([], 3), (["fox"], 1500)):
        got = [(r.id, round(r.score, 9)) for r in search.bm25_topk(index, query, k).collect()]
        every = {r.id: r.score for r in search.bm25_scores(index, query).collect()}
        want = sorted(((i, round(every.get(i, 0.0), 9)) for i in held), key=lambda x: (-x[1], x[0]))[:k]
        assert got == want
    read, every = (search.bm25_blocks(index, ["fox"], k)[0].count() for k in (5, None))
    assert every > 10 and read <= 4
    read, every = (search.bm25_blocks(index, ["w17"] * 9 + ["fox"], k)[0].count() for k in (1, None))
    assert read <= every
    plan = search.bm25_topk(index, ["sea"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(top", plan), plan


def test_rerank_falls_back_to_the_fusion(spark):
    c = spark.createDataFrame([(k, 1.0 / (k + 1), k) for k in range(4)], "id int, rrf_score double, x int")
    ids = lambda df: [(r.id, r.status) for r in df.collect()]
    assert ids(search.rerank_topk(c, F.col("x").cast("double"), 2)) == [(3, "reranked"), (2, "reranked")]
    assert ids(search.rerank_topk(c, None, 2)) == [(0, "unavailable"), (1, "unavailable")]
    assert ids(search.rerank_topk(c, F.col("x").cast("double"), 2, late=F.col("x") == 3)) == [(0, "timeout"), (1, "timeout")]
    assert ids(search.rerank_topk(c.limit(1), None, 2)) == [(0, "skipped")]


def test_passages(spark):
    passages = [(1, "the quick brown fox jumps over the lazy dog"), (2, "one two three"), (3, "zz"), (4, "a b"), (5, "nowhere to be found in any of these texts")]
    texts = [(1, "see the quick brown fox jumps over the lazy dogs"), (2, "xone two threex"), (3, "pizza"), (4, "ba bo"), (5, "the quick  brown fox jumps over the lazy dog")]
    got = search.passages_in(spark.createDataFrame(passages, "q int, passage string"), spark.createDataFrame(texts, "id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, p in passages for i, t in texts if p in t)


def test_session_store(spark):
    day = 86400
    writes = spark.createDataFrame([("a", 0, "x"), ("a", 5 * day, "y"), ("b", 0, None)], "k string, sec long, value string")
    asks = [("a", 10), ("a", day), ("a", 2 * day), ("a", 3 * day + 1), ("a", 3 * day + 2), ("a", 5 * day), ("a", 6 * day + 1), ("b", 1), ("c", 1)]
    got = session.session_store(writes, spark.createDataFrame(asks, "k string, sec long"), "k", "sec").collect()
    want = {("a", 10): "x", ("a", day): "x", ("a", 2 * day): "x", ("a", 5 * day): "y"}
    assert {(r.k, r.sec): r.value for r in got} == {k: want.get(k) for k in asks}


def test_cache_with_a_limit(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), f"k{rng.randrange(12)}", float(t)) for t in range(0, 4000, 7)]
    got = session.retrieval_cache(spark.createDataFrame(rows, "place string, key string, at double").repartition(3), 300, 5, "place").collect()
    held, want = {"p": [], "q": []}, {}
    for place, key, at in rows:
        own = held[place]
        old = next((x for x in own if x[0] == key), None)
        hit = old is not None and at - old[1] <= 300
        if old is not None:
            own.remove(old)
        own.append((key, old[1] if hit else at))
        del own[:-5]
        want[place, at] = hit
    assert {(r.place, r["at"]): r.hit for r in got} == want and 0 < sum(want.values()) < len(want)


def test_long_cycles_and_places(spark):
    ring = [("r", f"s{k}", [f"s{(k + 1) % 40}"]) for k in range(40)] + [("r", "tail", ["s0"]), ("r", "x", ["y"]), ("r", "y", [])]
    steps = spark.createDataFrame(ring, "plan string, id string, deps array<string>")
    assert {(r.id, r.violation) for r in graph.dag_validate(steps).collect()} == {(f"s{k}", "cycle") for k in range(40)}
    numbered = tables.number_rows(spark.range(1000).selectExpr("id * 7 % 1009 as x"), "x", "place").collect()
    assert [r.place for r in sorted(numbered, key=lambda r: r.x)] == list(range(1, 1001))


def test_bfs_plan_is_linear_in_depth(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(8)], "source string, target string")
    got = graph.graph_bfs(edges, "n0", 5, "upstream")
    assert sorted((r.node, r.depth) for r in got.collect()) == [(f"n{k}", k) for k in range(1, 6)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_formats_of_error_lines():
    assert re.search(logs.form(logs.TSC_LINE), "a b.ts(3,4): error TS23: no such thing").groups() == ("a b.ts", "3", "4", "no such thing")
    assert re.search(logs.form(logs.V8_FRAME), "   at new X (/a (b)/c.js:1:22)").groups()[1:] == ("1", "22")
    assert re.search(logs.form(logs.RUSTC_PLACE), "  --> src/a.rs:1:2").groups() == ("src/a.rs", "1", "2")
    assert not re.search(logs.form(logs.GCC_LINE), "a.c:1: warning: error")


def test_small_blocks_gather_alike(spark):
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randrange(1, 70) for _ in range(rng.randrange(1, 9))]
        ends = parse._cuts(sizes, 40)
        assert [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)] == list(value(spark, parse.merge_small_blocks(F.array(*map(F.lit, sizes)))))


def test_a_long_run_of_postings_is_put_together_once(monkeypatch):
    rows = [("a", k, 3, 10) for k in range(5)] + [("b", k, 2, 10) for k in range(2000)] + [("c", 7, 1, 10)]
    table = pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("term", "string"), ("id", "int64"), ("tf", "int64"), ("dl", "int32")))})
    seen = []
    monkeypatch.setattr(search, "_changes", lambda term, real=search._changes: seen.append(len(term)) or real(term))
    out = [r for b in search._blocks(10.0)(iter(table.to_batches(max_chunksize=10))) for r in b.to_pylist()]
    assert [(r["term"], i) for r in out for i in r["ids"]] == [(t, k) for t, k, *_ in rows]
    assert [r["run"] for r in out if r["ladder"]] == [5, 2000, 1] and max(len(r["ids"]) for r in out) == search.BLOCK
    assert sum(seen) < 4 * len(rows)  # each posting is looked at a few times, not once a batch
