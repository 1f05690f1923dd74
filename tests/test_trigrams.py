"""Searches with trigrams against searches without."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import search, trigrams
from cairn.sources.scratch import scratch


@pytest.mark.parametrize("pattern, need", [
    ("License", ("and", ["cen", "ens", "ice", "lic", "nse"])), ("ab", None), ("a.c", None), ("abc|xy", None), ("(abc|xyz)d", ("or", ["abc", "xyz"])), ("(abc)?def", "def"), ("(abc)+", "abc"),
    ("ab{2}c", None), ("(", None), ("[abc]def\\d+ghi", ("and", ["def", "ghi"])), ("", None), ("^abc$", "abc"), ("(?i)ABCD|wxyz", ("or", [("and", ["abc", "bcd"]), ("and", ["wxy", "xyz"])])),
])
def test_needs(pattern, need):
    assert trigrams.pattern_need(pattern) == need


def plain_grep(files, pattern, n, most):
    hits = [(p, k) for p, c in sorted(files) for k, x in enumerate(c.split("\n"), 1) if re.search(pattern, x)][:most]
    out = []
    for path in sorted({p for p, _ in hits}):
        own, lines = {k for p, k in hits if p == path}, dict(files)[path].split("\n")
        shown = sorted({w for k in own for w in range(k - n, k + n + 1) if 1 <= w <= len(lines)})
        grp = -1
        for w in shown:
            grp += (w - 1) not in shown
            out.append((path, w, lines[w - 1], w in own, grp))
    return sorted(out)


def test_grep(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "License", "license", "x", "(c)", "é", "gamma42", ""]
    files = [(f"d/{k}", "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(6))) for _ in range(rnd.randrange(12)))) for k in range(120)]
    frame = spark.createDataFrame(files, "path string, content string").repartition(3)
    index = trigrams.write_grams(frame, scratch(spark, "grams"), "path", "content")
    for pattern, n, most in (("License", 1, 100), ("gamma\\d+", 0, 7), ("(beta|alpha) x", 2, 1000), ("^x$", 1, 50), ("nowhere", 1, 9), ("amma", 3, 3)):
        for own in (index, None):
            got = sorted((r.path, r.line, r.text, r.matched, r.grp) for r in trigrams.grep_context(frame, pattern, n, most, own).collect())
            assert got == plain_grep(files, pattern, n, most)
    opened = {r.id for r in trigrams.candidates(index, trigrams.pattern_need("gamma\\d+")).collect()}
    assert {p for p, c in files if "gamma42" in c} == opened  # files that are searched, of 120
    empty = spark.createDataFrame([], "path string, content string")
    assert trigrams.grep_context(empty, "abc", index=trigrams.write_grams(empty, scratch(spark, "grams"), "path", "content")).count() == 0


def test_names(spark):
    rnd = random.Random(3)
    parts = ["get", "Set", "user", "Data", "base", "Loader", "x", "é"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randint(1, 4))), k) for k in range(900)] + [(900, None, 1), (901, "", 2)]
    frame = spark.createDataFrame(rows, "id long, name string, low_ int").repartition(4)
    index = trigrams.write_names(frame, scratch(spark, "names"), "name")
    for tokens, k in ((["Data"], 20), (["userdata", "zz"], 20), (["get"], 500), (["se"], 30), (["aseLo"], 10), (["é"], 5), (["none"], 5), (["x", "Loader"], 2000)):
        for contains in (True, False):
            want = search.symbol_topk(frame, tokens, k, "name", ["id"], contains).collect()
            got = trigrams.name_topk(index, tokens, k, "name", ["id"], contains).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in want], (tokens, k, contains)
    plan = trigrams.name_topk(index, ["data"], 5, "name", ["id"], False)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(low,data\)", plan), plan


def test_trigrams_are_written_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "FILE_ROWS", 50)
    rows = spark.createDataFrame([(k, f"word{k:03d}") for k in range(200)], "id int, w string").repartition(2)
    found = trigrams.write_grams(rows, path := scratch(spark, "grams"), "id", "w").select("gram", "id", F.input_file_name()).collect()
    assert len(found) == len({r[:2] for r in found}) == 200 * 5
    parts = {}
    for *_, file in found:
        parts.setdefault(re.search(r"part-(\d+)", file)[1], set()).add(file)
    assert len(parts) == 2 and sum(map(len, parts.values())) >= 20, path  # a partition's rows stay together, in files of 50 rows at most
