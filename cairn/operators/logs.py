"""Error logs and test reports to structures, in column expressions; diffs and JSON scanning in Arrow functions."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import diff_context_lines, err_norm_path, tail_slice

ERROR = "struct<error_type:string,error_message:string,file_path:string,line:int,col:int,language:string,parse_strategy:string,code_snippet:string>"
# Lines as the tools print them; ``{field}`` stands for what _FIELDS says, one blank for any number of them.
PYTHON_FRAME = 'File "{quoted}", line {number}, in {words}'
PYTHON_ERROR = "{dotted}: {words}"
V8_ERROR = "{error}:{rest}"
V8_FRAME = "at {call}{path}:{number}:{number}{end}"
TSC_LINE = "{path}({number},{number}): error TS{code}: {words}"
GCC_LINE = "{path}:{number}: error: {words}"
GCC_LINE_AND_COLUMN = "{path}:{number}:{number}: error: {words}"
RUSTC_ERROR = "error[{rustcode}]: {words}"
RUSTC_ERROR_WITHOUT_CODE = "error: {words}"
RUSTC_PLACE = "--> {path}:{number}:{number}"
PYTEST_SUMMARY = "{any}- {error}: {words}"
PYTHON_MESSAGE = "{error}: {words}"
PYTHON_MESSAGE_WITH_PLACE = "{error}: {words} ({path}, line {number})"

_FIELDS = {
    "quoted": '([^"]+)', "path": "(.+?)", "number": "([0-9]+)", "words": "(.+?)", "rest": "(.*?)", "any": ".*", "call": "(?:.*[(])?", "end": "[)]?",
    "code": "[0-9]+", "rustcode": "(E[0-9]+)", "error": "([A-Z]\\w*Error|Error)", "dotted": "([A-Z]\\w*Error(?:[.][A-Z]\\w*)?)",
}


def form(line: str) -> str:
    """The regular expression of a whole line of that form, with a group per field."""
    parts = re.split(r"\{(\w+)\}", line)
    escaped = [re.escape(p).replace("\\ ", "\\s+") if k % 2 == 0 else _FIELDS[p] for k, p in enumerate(parts)]
    return r"(?m)^[ \t]*" + "".join(escaped).replace(r":\s+", r":\s*") + r"[ \t\r]*$"


TRACEBACK = "Traceback (most recent call last):"
KEYWORDS = ("error", "failed", "fatal", "exception", "traceback")


def _all(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(raw, F.lit(pattern), F.lit(group))


def _last(raw: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(_all(raw, pattern, group), F.lit(-1))


def _first(raw: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(_all(raw, pattern, group), F.lit(1))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c).cast("int")


def _error(kind, message, file=None, line=None, col=None, language=None, how="", snippet=None) -> Column:
    none = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(kind).alias("error_type"), F.trim(lit(message)).alias("error_message"), (none if file is None else file).alias("file_path"), (number if line is None else line).alias("line"),
        (number if col is None else col).alias("col"), (none if language is None else lit(language)).alias("language"), F.lit(how).alias("parse_strategy"), (none if snippet is None else snippet).alias("code_snippet"),
    )


def _says(raw: Column, *parts: str) -> Column:
    """Whether the text has all the parts: cheap, and asked before any pattern is tried."""
    out = F.lit(True)
    for part in parts:
        out = out & F.contains(raw, F.lit(part))
    return out


def err_py_traceback(raw: Column, cwd: Column) -> Column:
    """The innermost frame and the last error line; the last three lines of code shown."""
    frame, error = form(PYTHON_FRAME), form(PYTHON_ERROR)
    kind, file, line = _last(raw, error, 1), _last(raw, frame, 1), _int(_last(raw, frame, 2))
    code = F.filter(F.split(raw, "\r?\n"), lambda x: x.startswith("    ") & ~x.startswith("    File") & (F.trim(x) != ""))
    snippet = F.nullif(F.array_join(F.transform(tail_slice(code, 3), lambda x: F.trim(x)), "\n"), F.lit(""))
    whole = _error(
        F.coalesce(kind, F.lit("UnknownError")), F.coalesce(_last(raw, error, 2), F.left(F.trim(raw), F.lit(200))), err_norm_path(file, cwd), line, None,
        "python", "python_traceback", F.when(line.isNotNull(), snippet),
    )
    return F.when(_says(raw, TRACEBACK), F.when(kind.isNotNull() | file.isNotNull(), whole))


def err_js_stack(raw: Column, cwd: Column) -> Column:
    """The topmost frame, and the error line if there is one."""
    frame, error = form(V8_FRAME), form(V8_ERROR)
    file, kind = err_norm_path(_first(raw, frame, 1), cwd), _first(raw, error, 1)
    language = F.when(kind.isNotNull() & F.lower(file).rlike(r"\.tsx?$"), "typescript").otherwise("javascript")
    message = F.when(kind.isNull(), F.left(F.element_at(F.split(F.trim(raw), "\r?\n"), 1), F.lit(200))).otherwise(F.coalesce(_first(raw, error, 2), F.lit("")))
    found = _error(F.coalesce(kind, F.lit("Error")), message, file, _int(_first(raw, frame, 2)), _int(_first(raw, frame, 3)), language, "js_stack")
    return F.when(_says(raw, "at ", ":"), F.when(file.isNotNull(), found))


def err_compiler(raw: Column, cwd: Column) -> Column:
    """The last error line of a compiler; of rustc the first error and its last place."""
    tsc, with_column, without, place = form(TSC_LINE), form(GCC_LINE_AND_COLUMN), form(GCC_LINE), form(RUSTC_PLACE)
    numbers = lambda p, *at: [_int(_last(raw, p, k)) for k in at]
    file = lambda p: err_norm_path(_last(raw, p, 1), cwd)
    typescript = _error("CompileError", _last(raw, tsc, 4), file(tsc), *numbers(tsc, 2, 3), "typescript", "ts_compiler")
    cpp = lambda p: F.when(F.lower(_last(raw, p, 1)).rlike(r"\.(cpp|cc|hpp)$"), "cpp").otherwise("c")
    c_column = _error("CompileError", _last(raw, with_column, 4), file(with_column), *numbers(with_column, 2, 3), cpp(with_column), "gcc_compiler")
    c_line = _error("CompileError", _last(raw, without, 3), file(without), *numbers(without, 2), None, cpp(without), "gcc_compiler")
    coded, plain = form(RUSTC_ERROR), form(RUSTC_ERROR_WITHOUT_CODE)
    code = F.coalesce(_first(raw, coded, 1), F.lit(""))
    message = F.coalesce(_first(raw, coded, 2), _first(raw, plain, 1))
    rust = _error(F.concat(F.lit("RustError"), code), message, file(place), *numbers(place, 2, 3), "rust", "rustc_compiler")
    return F.coalesce(
        F.when(_says(raw, "error TS"), F.when(raw.rlike(tsc), typescript)),
        F.when(_says(raw, "error"), F.coalesce(F.when(raw.rlike(with_column), c_column), F.when(raw.rlike(without), c_line))),
        F.when(_says(raw, "error", "-->"), F.when(message.isNotNull() & raw.rlike(place), rust)),
    )


def err_py_direct(raw: Column, cwd: Column) -> Column:
    """An error line without a traceback: of a test report, or alone, perhaps with its place."""
    summary, alone, placed = form(PYTEST_SUMMARY), form(PYTHON_MESSAGE), form(PYTHON_MESSAGE_WITH_PLACE)
    pytest = _error(_first(raw, summary, 1), _first(raw, summary, 2), language="python", how="pytest_error")
    line = F.try_element_at(_all(raw, alone, 0), F.lit(1))
    own = lambda k: F.nullif(F.regexp_extract(line, placed, k), F.lit(""))
    with_place = _error(own(1), own(2), err_norm_path(own(3), cwd), _int(own(4)), language="python", how="python_direct")
    without = _error(_first(raw, alone, 1), _first(raw, alone, 2), language="python", how="python_direct")
    direct = F.when(line.rlike(placed), with_place).when(line.isNotNull(), without)
    return F.when(_says(raw, "Error") & ~_says(raw, TRACEBACK), F.coalesce(F.when(_says(raw, "- ") & raw.rlike(summary), pytest), direct))


def err_fallback(raw: Column) -> Column:
    tail = F.right(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit(200))
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.filter(lines, lambda x: F.lower(x).rlike("|".join(KEYWORDS)))
    return _error("Unknown", F.coalesce(F.try_element_at(marked, F.lit(-1)), F.try_element_at(lines, F.lit(1)), F.lit("(empty)")), how="fallback")


def parse_error(raw: Column, cwd: Column) -> Column:
    """The first parser that knows the text: traceback, stack, compiler, direct, then the fallback."""
    r = F.coalesce(raw, F.lit(""))
    return F.coalesce(*[c.cast(ERROR) for c in (err_py_traceback(r, cwd), err_js_stack(r, cwd), err_compiler(r, cwd), err_py_direct(r, cwd), err_fallback(r))])


def _count(text: Column, word: str) -> Column:
    return F.coalesce(_int(F.regexp_extract(text, rf"(\d+)\s+{word}\b", 1)), F.lit(0))


def parse_pytest(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    full = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    passed, failed, errors, skipped = (_count(full, w) for w in ("passed", "failed", "errors?", "skipped"))
    lines = F.filter(F.transform(F.split(F.coalesce(stdout, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(FAILED|ERROR)\s+\S"))

    def failure(line: Column) -> Column:
        """What stands behind the status word is cut at the first hyphen: the test, then why it failed."""
        rest = F.substring_index(line, " ", 1)
        rest = F.trim(F.substr(line, F.length(rest) + 1))
        rest = F.when(line.startswith("FAILED"), F.regexp_replace(rest, r"^\[[^\]]*\]\s+", "")).otherwise(rest)
        at = F.instr(F.substr(rest, F.lit(2)), "-") + 1  # a test's name has a character at least
        why = F.when(at > 1, F.trim(F.substr(rest, at + 1))).otherwise("")
        default = F.when(line.startswith("FAILED"), "assertion failed").otherwise("test error")
        name = F.when((at > 1) & (why != ""), F.trim(F.substr(rest, F.lit(1), at - 1))).otherwise(rest)
        return F.struct(name.alias("test_name"), F.when(why != "", why).otherwise(default).alias("error"))

    failures = F.transform(F.slice(lines, 1, 20), failure)
    return F.struct(((failed == 0) & (errors == 0) & (exit_code == 0)).alias("success"), passed.alias("passed"), failed.alias("failed"), errors.alias("errors"), skipped.alias("skipped"), (passed + failed + errors + skipped).alias("total"), failures.alias("failures"))


def parse_jest(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    full = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    whole = "".join((r"Tests:\s+", _A_NUMBER, r"failed,\s*", _A_NUMBER, r"passed[,\s]*", _A_NUMBER, "skipped"))
    part = lambda k: _int(F.regexp_extract(full, whole, k))
    is_whole = full.rlike(whole)
    only = F.coalesce(_int(F.regexp_extract(full, r"Tests:\s+" + _A_NUMBER + "passed", 1)), F.lit(0))
    silent = ~is_whole & (exit_code != 0) & (only == 0)  # the exit code speaks only where no test is counted
    failed = F.when(is_whole, part(1)).when(silent, 1).otherwise(0)
    passed, skipped = F.when(is_whole, part(2)).otherwise(only), F.when(is_whole, part(3)).otherwise(0)
    marked = F.filter(F.transform(F.split(F.coalesce(stdout, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^●\s+\S"))
    failures = F.transform(F.slice(marked, 1, 20), lambda x: F.struct(F.trim(F.substr(x, F.lit(2))).alias("test_name"), F.lit("test failed").alias("error")))
    return F.struct(
        ((failed == 0) & (exit_code == 0)).alias("success"), passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), (passed + failed + skipped).alias("total"), failures.alias("failures")
    )


_A_NUMBER = r"(\d+)\s+"


def test_summary(timed_out: Column, success: Column, message: Column, passed: Column, failed: Column, errors: Column, skipped: Column) -> Column:
    """One line for a run's result; its wording is fixed."""
    n = lambda c, word: F.concat(c.cast("string"), F.lit(" " + word))
    message = F.coalesce(message, F.lit(""))
    return (
        F.when(timed_out, F.concat(F.lit("测试超时中止（"), message, F.lit("）")))
        .when(success, F.concat(F.lit("测试全部通过 ✅ ("), n(passed, "passed)")))
        .when(message != "", F.concat(F.lit("测试框架不可用: "), message))
        .otherwise(F.concat(F.lit("测试存在失败 ❌ ("), n(passed, "passed, "), n(failed, "failed, "), n(errors, "errors, "), n(skipped, "skipped)")))
    )


test_summary.__test__ = False


def _diffs(path: pd.Series, old: pd.Series, new: pd.Series, context: pd.Series) -> pd.Series:
    def one(p, a, b, n):
        a, b = a or "", b or ""
        return "" if a == b else "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{p}", f"b/{p}", n=int(n)))[:200_000]

    return pd.Series([one(*x) for x in zip(path, old, new, context, strict=True)], dtype=object)


def unified_diff(path: Column, old: Column, new: Column, context: Column) -> Column:
    """Unified diff of two texts; equal texts give an empty one; cut at 200,000 characters."""
    return F.pandas_udf(_diffs, "string")(path, old, new, context)


#: What changes the depth of braces: a string as a whole (or its unclosed start), or a brace.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def _first_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` outside strings that parses once trailing commas and control characters are gone."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for m in _TOKENS.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            cut = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", re.sub(r",\s*([}\]])", r"\1", text[start : m.end()]))
            try:
                return json.dumps(json.loads(cut), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return None
    return None


def _first_objects(text: pd.Series) -> pd.Series:
    return text.map(_first_object)


def json_first_object(text: Column) -> Column:
    return F.pandas_udf(_first_objects, "string")(text)


#: The status letters that are passed on.
STATUS_LETTERS = "MADRC?U"


def git_status_parse(line: Column) -> Column:
    """(status, path) of a line of the short status: the index's letter, where it is blank the worktree's; ``?`` for letters that are not known.
    Of a move the new path. Null for lines that are too short."""
    line = F.rtrim(F.regexp_replace(line, r"[\r\n\t]+$", ""))
    x, rest = F.substring(line, 1, 1), F.substring(line, 4, 1 << 30)
    letter = F.when(x == " ", F.substring(line, 2, 1)).otherwise(x)
    status = F.when(F.contains(F.lit(STATUS_LETTERS), letter), letter).otherwise("?")
    moved = F.instr(rest, " -> ")
    path = F.when(moved > 0, F.substr(rest, moved + 4)).otherwise(rest)
    return F.when(F.length(line) >= 4, F.struct(status.alias("status"), path.alias("path")))


# Messages of error codes.
ERROR_MESSAGES = {
    10001: "无效的 API Key", 10002: "Token 已过期", 10003: "无效的 Token", 10101: "模型调用频率超限，请稍后重试", 10102: "输入内容过长，请缩短后重试",
    10103: "模型响应超时，请稍后重试", 10104: "网络连接失败，请检查网络", 10105: "模型服务异常，请稍后重试", 10106: "请求参数错误", 10201: "服务器内部错误", 10202: "服务暂时不可用",
}


def unresolved_errors(code: Column) -> Column:
    """The message of an error code."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_MESSAGES.items() for x in kv]), code), F.lit("未知错误"))


def detect_framework(tests: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, framework) from test files (project, kind) and the projects' package.json (project, package; null where there
    is none): jest as a dependency, an npm test script, any JavaScript test, any Python test, else unknown."""
    kinds = tests.groupBy("project").agg(F.bool_or(F.col("kind") == "javascript").alias("js"), F.bool_or(F.col("kind") == "python").alias("py"))
    at = lambda p: F.get_json_object("package", p)
    jest = at("$.dependencies.jest").isNotNull() | at("$.devDependencies.jest").isNotNull()
    script = F.coalesce(at("$.scripts.test"), F.lit("")) != ""
    name = F.when(F.col("js").isNull(), "unknown").when(jest, "jest").when(script & F.col("js"), "npm_test").when(F.col("js"), "jest").otherwise("pytest")
    return projects.join(kinds, "project", "left").select("project", name.alias("framework"))


def should_run_tests(enabled: bool, tool: Column, tests: Column) -> Column:
    """Whether a repair is followed by the tests: switched on, a file written, and tests there."""
    return F.lit(enabled) & (tool == "write_file") & F.coalesce(tests > 0, F.lit(False))


def timeout_result(framework: Column, stdout: Column, seconds: int = 60) -> Column:
    """The result row of a run that was stopped: one error, nothing passed, 2,000 characters of output."""
    zero = F.lit(0)
    return F.struct(
        F.lit(False).alias("success"), framework.alias("framework"), zero.alias("passed"), zero.alias("failed"), F.lit(1).alias("errors"), zero.alias("skipped"), zero.alias("total"),
        F.left(F.coalesce(stdout, F.lit("")), F.lit(2000)).alias("stdout"), F.lit(True).alias("timed_out"), F.lit(f"timed out after {seconds}s").alias("error_message"),
    )


def build_diff_files(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, old_content, new_content, diff) of proposed files (path, content) against those there; rows without path or
    content are left out, and the longer text decides how much context is shown."""
    good = proposed.filter("path <> '' and content is not null").select("path", F.col("content").alias("new_content"))
    both = good.join(current.select("path", F.col("content").alias("old_content")), "path", "left").withColumn("old_content", F.coalesce("old_content", F.lit("")))
    return both.withColumn("diff", unified_diff(F.col("path"), F.col("old_content"), F.col("new_content"), diff_context_lines(F.col("old_content"), F.col("new_content"))))
