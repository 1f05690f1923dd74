"""More operators bound to the driver's tables: predicates, stores, plans, caches and the parts of larger operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import context, graph, logs, metrics, parse, plans, search, session, workspace
from cairn.plans import fixtures
from cairn.plans.bindings import _EDGES, _STEPS, _TERMS, _TOK, _edges, _steps, query, t
from cairn.sources import stores, tables
from cairn.sources.scratch import spread, spread_by

# --- text and predicates --------------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(p, '\\.([^./\\\\]+)$', 1))"
_PATHS = "(SELECT page_id, 'src/f' || page_id || '.' || ['py', 'JS', 'tsx', 'rs', 'java', 'go', 'txt', 'kt'][(page_id % 8 + 1)::INT] AS p FROM pages)"


def _paths(spark, d) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("py", "JS", "tsx", "rs", "java", "go", "txt", "kt"))), (F.col("page_id") % 8 + 1).cast("int"))
    return t(spark, d, "pages").select("page_id", F.concat(F.lit("src/f"), "page_id", F.lit("."), ext).alias("p"))


def _case(table: dict[str, str], unknown: str) -> str:
    return f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{unknown}' END"


@query(f"SELECT page_id, {_case(X.INDEX_LANGUAGES, 'unknown')} AS language FROM {_PATHS}")
def detect_language(spark, d):
    return _paths(spark, d).select("page_id", X.detect_language(F.col("p")).alias("language"))


@query(f"SELECT page_id, {_case(X.DISPLAY_LANGUAGES, '')} AS language FROM {_PATHS}")
def detect_language_ext(spark, d):
    return _paths(spark, d).select("page_id", X.detect_language_ext(F.col("p")).alias("language"))


@query("SELECT page_id, CASE WHEN regexp_matches(b, '^test_.*\\.py$|_test\\.py$') THEN 'python' WHEN regexp_matches(b, '\\.(test|spec)\\.(js|jsx|ts|tsx)$') THEN 'javascript' END AS kind FROM (SELECT page_id, ['test_', 'x'][(page_id % 2 + 1)::INT] || page_id || ['.py', '.test.ts', '_test.py'][(page_id % 3 + 1)::INT] AS b FROM pages)")
def is_test_file_pat(spark, d):
    a = F.element_at(F.array(F.lit("test_"), F.lit("x")), (F.col("page_id") % 2 + 1).cast("int"))
    b = F.element_at(F.array(F.lit(".py"), F.lit(".test.ts"), F.lit("_test.py")), (F.col("page_id") % 3 + 1).cast("int"))
    return t(spark, d, "pages").select("page_id", X.is_test_file_pat(F.concat(a, "page_id", b)).alias("kind"))


@query(r"""WITH x AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]*/', '/w/x/../') AS p FROM pages),
y AS (SELECT *, list_reduce(list_prepend('', string_split(replace(CASE WHEN starts_with(p, '/') THEN p ELSE '/w/' || p END, chr(92), '/'), '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END) AS f FROM x),
z AS (SELECT *, CASE WHEN f = '/w' THEN '.' WHEN starts_with(f, '/w/') THEN substr(f, 4) END AS rel FROM y)
SELECT page_id, rel, starts_with(url, 'https://') AND rel IS NOT NULL AS inside FROM z""")
def workspace_relative(spark, d):
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*/", "/w/x/../")
    within = F.when(F.col("url").startswith("https://"), path).otherwise(F.lit("/w/../x"))
    return t(spark, d, "pages").select("page_id", X.workspace_relative(path, "/w").alias("rel"), X.path_within(within, "/w").alias("inside"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS path FROM pages")
def err_norm_path(spark, d):
    return t(spark, d, "pages").select("page_id", X.err_norm_path(F.col("url"), F.lit("https:/")).alias("path"))


@query("SELECT doc_id, length(text) <= 50000 AS allowed FROM documents")
def snippet_guard(spark, d):
    return t(spark, d, "documents").select("doc_id", X.snippet_guard(F.col("text")).alias("allowed"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AS recent FROM events")
def filter_recent(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t(spark, d, "events").select("event_id", X.filter_recent(at, F.lit(1706659200), 1).alias("recent"))


@query("SELECT o_custkey, coalesce(round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4), 0)::DOUBLE AS progress FROM orders GROUP BY o_custkey")
def project_status(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("done"), F.count(F.lit(1)).alias("n"))
    return o.select("o_custkey", X.project_status(F.col("done"), F.col("n")).alias("progress"))


@query(r"SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^(import\s|from\s+\S+\s+import|import\s+\{|import\s+\*|import\s+[\"'']|import\s+\w+|export\s+|static\s+import|package\s+|require\s*\()')) AS imports, count(*) FILTER (trim(line) <> '' AND (starts_with(trim(line), '/*') OR starts_with(trim(line), '*') OR starts_with(trim(line), '//'))) AS comments, count(*) FILTER (regexp_matches(trim(line), '^((public|private|protected|static|final|abstract|async|export|default)\s+)*(function|class)\s+') OR regexp_matches(trim(line), '\)\s*\{|=>\s*\{') OR starts_with(trim(line), 'func ')) AS signatures FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def line_kinds(spark, d):
    # each text's lines are counted where it lies
    n = lambda test: F.size(F.filter(F.split("text", "\n", -1), test)).cast("long")
    go = F.lit("go")
    return t(spark, d, "documents").select(
        "doc_id", n(X.is_import_line).alias("imports"), n(lambda x: X.is_comment_line(x, go)).alias("comments"), n(lambda x: X.is_signature_line(x, go)).alias("signatures")
    )


@query(f"SELECT doc_id, trim(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[。.？?！!，,；;]+$', '')) AS q FROM documents")
def normalize_query(spark, d):
    return t(spark, d, "documents").select("doc_id", X.normalize_query(F.col("text")).alias("q"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 380) END AS cut FROM documents")
def truncate_text_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", X.truncate_text_tokens(F.col("text"), F.lit(100)).alias("cut"))


@query("SELECT page_id, left(nullif(trim(url), ''), 20) AS id FROM pages")
def sanitize_request_id(spark, d):
    return t(spark, d, "pages").select("page_id", X.sanitize_request_id(F.concat(F.lit("  "), "url", F.lit(" ")), 20).alias("id"))


@query("SELECT page_id, url AS line FROM pages")
def rg_norm(spark, d):
    return t(spark, d, "pages").select("page_id", X.rg_norm(F.concat(F.lit(".\\"), F.replace("url", F.lit("/"), F.lit("\\")))).alias("line"))


_NOT_NAMES = "[" + ", ".join(f"'{w}'" for w in X.SYMBOL_STOP_WORDS) + "]"


@query(rf"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '#([\p{{L}}\p{{N}}_]+)', 1) || list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]+)', 1), lambda w: NOT list_contains({_NOT_NAMES}, lower(w))) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ' ') AS tokens FROM x""")
def symbol_tokens(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.symbol_tokens(F.col("text")), " ").alias("tokens"))


#: (command, whether it is refused, whether it waits for input); ``#`` stands for a part's key.
_COMMANDS = (
    ("rm -rf /", True, False), ("rm -rf ./t#", False, False), ("sudo ls #", True, False), ("ls -l #", False, False), ("npm init", False, True), ("npm init -y #", False, False),
    ("python3", False, True), ("python3 a#.py", False, False), ("ssh host#", False, True), ("ssh -T host#", False, False), ("passwd u#", False, True), ("mysql -u root -p", False, True), ("", False, False),
)


@query("SELECT p_partkey, replace(c, '#', p_partkey::VARCHAR) AS cmd, danger, interactive FROM part, (VALUES " + ", ".join(f"('{c}', {a}, {b})" for c, a, b in _COMMANDS) + ") v(c, danger, interactive)")
def command_guards(spark, d):
    made = F.explode(F.array(*[F.replace(F.lit(c), F.lit("#"), F.col("p_partkey").cast("string")) for c, _, _ in _COMMANDS])).alias("cmd")
    return t(spark, d, "part").select("p_partkey", made).select("p_partkey", "cmd", X.is_danger_cmd(F.col("cmd")).alias("danger"), X.is_interactive_cmd(F.col("cmd")).alias("interactive"))


@query("SELECT p_partkey, lower(p_name) = 'bolt' OR ends_with(lower(p_name), '.bolt') AS hit FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS p_name FROM part)")
def match_call_target(spark, d):
    return t(spark, d, "part").select("p_partkey", X.match_call_target(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("Bolt")).alias("hit"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name <> '' AND NOT starts_with(p_name, '_') ELSE regexp_matches(p_name, '^[./]') END AS local FROM part")
def looks_local_module(spark, d):
    return t(spark, d, "part").select("p_partkey", X.looks_local_module(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "python").otherwise("typescript")).alias("local"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(#|//)[^\n]*', '', 'g'), '\b[A-Za-z_]{6,}\b', 'id', 'g') AS text FROM documents""")
def anonymize(spark, d):
    return t(spark, d, "documents").select("doc_id", X.anonymize(F.col("text")).alias("text"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '无效的 API Key' WHEN 'error' THEN '服务器内部错误' ELSE '未知错误' END AS message FROM events")
def unresolved_errors(spark, d):
    code = F.when(F.col("event_type") == "click", 10001).when(F.col("event_type") == "error", 10201).otherwise(1)
    return t(spark, d, "events").select("event_id", logs.unresolved_errors(code).alias("message"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE p_partkey WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END, p_retailprice, p_partkey) AS place FROM part")
def reorder_priority(spark, d):
    files = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("path"), F.struct("p_retailprice", "p_partkey").alias("pos"))
    ranked = tables.reorder_priority(files, ["7", "3", "7", "none"], "pos")
    return tables.number_rows(ranked.select("p_partkey", F.col("place").alias("at")), "at", "place").select("p_partkey", F.col("place").cast("int").alias("place"))


@query("SELECT p_partkey, least(floor(p_size * 1000 * 0.7::DOUBLE)::BIGINT, 8000) AS budget FROM part")
def compute_budget(spark, d):
    return t(spark, d, "part").select("p_partkey", X.compute_budget(F.col("p_size") * 1000).alias("budget"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 500 THEN 3 ELSE 1000 END AS n FROM documents")
def diff_context_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", X.diff_context_lines(F.col("text"), F.lit("")).alias("n"))


# --- retrieval ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'own' END AS file_path FROM documents")
def enrich_candidates(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"))
    return search.enrich_candidates(docs.select("id", F.when(F.col("id") % 2 == 0, "").otherwise("own").alias("file_path")), docs, ["file_path"])


@query(f"WITH r AS (SELECT doc_id AS id, len(list_intersect(list_distinct({_TOK}), ['license', 'released', 'dans'])) / 3.0 AS s, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) SELECT id, round(s, 6)::DOUBLE AS score FROM r ORDER BY s DESC, n_chars DESC, id LIMIT 5")
def rerank_topk(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("double").alias("rrf_score"))
    return search.rerank_topk(docs, search.overlap_score(_TERMS, F.col("text"))).select("id", F.round("rerank_score", 6).alias("score"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentile(spark, d):
    return search.exact_quantiles(t(spark, d, "events"), ["event_type"], "value", {"p95": 0.95}).select("event_type", F.round("p95", 6).alias("p95"))


@query("SELECT 'k/' || p_partkey || '.py' AS file_path FROM part WHERE p_size < 25 AND p_partkey % 3 <> 0")
def filter_ws_results(spark, d):
    found = t(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "/other/").otherwise("/w/k/"), "p_partkey", F.lit(".py")).alias("file_path"))
    files = t(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("k/"), "p_partkey", F.lit(".py")).alias("file_path"))
    return tables.filter_ws_results(found, files, "/w")


def _requests(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.lower("event_type").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"))


@query("""WITH RECURSIVE q AS (SELECT event_type AS key, floor(epoch(ts))::DOUBLE AS sec, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))) AS n FROM events),
r AS (SELECT key, n, sec, sec AS since, false AS hit FROM q WHERE n = 1 UNION ALL SELECT q.key, q.n, q.sec, CASE WHEN q.sec - since <= 300 THEN since ELSE q.sec END, q.sec - since <= 300 FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1)
SELECT key, sec AS "at", hit FROM r""")
def retrieval_cache(spark, d):
    return session.retrieval_cache(_requests(spark, d))


# --- graph and plans ------------------------------------------------------------------------------------------------


@query("SELECT 'f' || l_orderkey || '::m' || l_linenumber AS source, l_partkey AS target FROM lineitem WHERE l_orderkey = 1")
def graph_symbols(spark, d):
    calls = t(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_orderkey", F.lit("::m"), "l_linenumber").alias("source"), F.col("l_partkey").alias("target"))
    return graph.graph_symbols(calls, "f1")


#: A workspace: each order is a file that imports its parts and calls them from a function each; a part with an even key is a file, of the others
#: those whose key three divides are packages, and the rest is not there. Each order also imports itself.
_ITEMS = """i AS (SELECT l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT *, 'pkg.p' || p AS module, CASE WHEN p % 2 = 0 THEN 'pkg/p' || p || '.py' WHEN p % 3 = 0 THEN 'pkg/p' || p || '/__init__.py' END AS file FROM i)"""


def _workspace(spark, d) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey")
    orders = spread_by(t(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    part = lambda x: x["l_partkey"].cast("string")
    imports = F.transform("items", lambda x: F.concat(F.lit("from pkg.p"), part(x), F.lit(" import run")))
    bodies = F.transform("items", lambda x, k: F.concat(F.lit("def f"), (k + 1).cast("string"), F.lit("(x):\n    return p"), part(x), F.lit(".run(x)")))
    key = F.col("l_orderkey").cast("string")
    lines = F.concat(imports, F.array(F.concat(F.lit("import o"), key), F.lit("")), bodies, F.array(F.lit("f1(0)")))
    files = orders.select(F.concat(F.lit("o"), key, F.lit(".py")).alias("path"), F.array_join(lines, "\n").alias("content"))
    number = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("pkg/p"), number, F.lit(".py"))).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pkg/p"), number, F.lit("/__init__.py")))
    parts = spread(t(spark, d, "part").select("p_partkey")).select(path.alias("path"), F.lit("def run(x):\n    return x\n").alias("content")).filter("path is not null")
    return files.unionByName(parts).withColumn("language", X.detect_language(F.col("path")))


@query(f"""WITH {_ITEMS}, x AS (
SELECT 'o' || o || '.py' AS source, coalesce(file, module) AS target, 'import' AS edge_type, 'file' AS source_type, k AS line, module AS raw FROM m
UNION ALL SELECT DISTINCT 'o' || o || '.py', 'o' || o, 'import', 'file', n + 1, 'o' || o FROM m
UNION ALL SELECT 'o' || o || '.py::f' || k, 'p' || p || '.run', 'call', 'symbol', n + 2 + 2 * k, 'p' || p || '.run' FROM m
UNION ALL SELECT DISTINCT 'o' || o || '.py', 'f1', 'call', 'file', 3 * n + 3, 'f1' FROM m)
SELECT source, target, edge_type, source_type, max(line)::INT AS line, raw FROM x GROUP BY ALL""")
def build_edges(spark, d):
    return workspace.file_edges(_workspace(spark, d))


@query(f"WITH {_ITEMS} SELECT DISTINCT 'python' AS language, module, file AS target FROM m UNION ALL SELECT DISTINCT 'python', 'o' || o, 'o' || o || '.py' FROM m")
def resolve_import(spark, d):
    files = _workspace(spark, d)
    refs = workspace.read_imports(files)
    return graph.resolve_import(refs.select(F.lit("python").alias("language"), "module"), files.select(F.col("path").alias("file_path")))


@query(f"WITH {_STEPS} SELECT plan, bool_and(status IN ('done', 'blocked')) AS all_done FROM st GROUP BY plan")
def all_done(spark, d):
    return graph.plan_progress(_steps(spark, d)).select("plan", "all_done")


@query(f"WITH {_STEPS} SELECT plan, bool_or(status = 'failed') AS any_failed FROM st GROUP BY plan")
def any_failed(spark, d):
    return graph.plan_progress(_steps(spark, d)).select("plan", "any_failed")


def _raw_plans(spark, d) -> DataFrame:
    """Each customer's orders as a plan in JSON; an order in status P has a blank description."""
    o = t(spark, d, "orders").withColumn("before", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    step = F.struct(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("description"),
        F.filter(F.array(F.when(F.lit(False), F.col("before").cast("string"))), lambda x: x.isNotNull()).alias("dependencies"), F.when(F.col("o_orderstatus") == "F", "run_command").otherwise("fly").alias("suggested_tool"),
    )
    return o.groupBy(F.col("o_custkey").alias("plan")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(step)).alias("plan"))).alias("raw"))


_RAW_STEPS = "r AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders)"


@query(f"WITH {_RAW_STEPS} SELECT plan, ord::INT AS ord, CASE WHEN s <> 'O' THEN o_orderkey::VARCHAR ELSE 'step_' || (ord + 1)::VARCHAR END AS id, CASE WHEN s = 'P' THEN '' ELSE p END AS description, CASE WHEN s = 'F' THEN 'run_command' ELSE '' END AS action FROM r")
def plan_convert(spark, d):
    return plans.plan_convert(_raw_plans(spark, d)).select("plan", "ord", "id", "description", "action")


@query(f"WITH {_RAW_STEPS} SELECT DISTINCT plan, 'description' AS violation FROM r WHERE s = 'P' UNION ALL SELECT plan, 'count' FROM r GROUP BY plan HAVING count(*) NOT BETWEEN 5 AND 10")
def plan_merge_checks(spark, d):
    return plans.plan_merge_checks(_raw_plans(spark, d))


# --- sessions -------------------------------------------------------------------------------------------------------

_LOOKUPS = "l AS (SELECT l_orderkey AS token, l_partkey * 100000 + l_suppkey AS ord, l_quantity::INT * 20 AS sec, CASE WHEN l_returnflag = 'R' THEN 'pop' ELSE 'get' END AS kind FROM lineitem)"


@query(f"WITH {_LOOKUPS}, x AS (SELECT *, sec > 300 AS late, coalesce(max((kind = 'pop' OR sec > 300)::INT) OVER (PARTITION BY token ORDER BY sec, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone FROM l) SELECT token, ord, NOT gone AND (kind = 'pop' OR NOT late) AS found FROM x")
def confirm_store(spark, d):
    looked = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("token"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"), (F.col("l_quantity").cast("int") * 20).alias("at"), F.when(F.col("l_returnflag") == "R", "pop").otherwise("get").alias("kind"))
    return session.confirm_store(t(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.lit(0).alias("issued_at")), looked).select("token", "ord", "found")


@query("SELECT event_id FROM events WHERE epoch(ts) > epoch(TIMESTAMP '2024-01-31') - 86400 * 10")
def rate_cleanup(spark, d):
    e = t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return session.rate_cleanup(e, "s", 1706659200.0, 864000).select("event_id")


@query("SELECT event_id FROM events WHERE ts::DATE > DATE '2024-01-31' - 7")
def quota_cleanup(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return session.quota_cleanup(e, "day", F.lit("2024-01-31").cast("date"), 7).select("event_id")


@query("SELECT event_id, ceil(value + 60 - 30)::BIGINT AS reset FROM events")
def rate_reset(spark, d):
    return t(spark, d, "events").select("event_id", session.rate_reset(F.col("value"), F.lit(30)).alias("reset"))


@query("WITH m AS (SELECT *, floor(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4)::BIGINT AS i, floor(length(coalesce(text, '')) / 4)::BIGINT AS o FROM conversations) SELECT conv_id, turn, i + o AS tokens FROM m WHERE role = 'assistant'")
def token_usage_record(spark, d):
    return session.token_usage_record(t(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "tokens")


@query("SELECT round(avg(n), 6) AS avg_rounds, count(*) AS tasks FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id)")
def avg_rounds(spark, d):
    return metrics.avg_rounds(t(spark, d, "conversations"), "conv_id")


@query("WITH b AS (SELECT l_shipmode AS model, round(avg(p), 6) AS pass_rate, count(*) AS problems FROM (SELECT l_linestatus || l_linenumber AS l_shipmode, l_orderkey, bool_or(l_returnflag = 'R')::INT::DOUBLE AS p FROM lineitem GROUP BY ALL) GROUP BY 1) SELECT *, rank() OVER (ORDER BY pass_rate DESC)::INT AS place FROM b")
def leaderboard(spark, d):
    li = t(spark, d, "lineitem").withColumn("model", F.concat("l_linestatus", "l_linenumber"))
    return metrics.leaderboard(li, "model", "l_orderkey", F.col("l_returnflag") == "R")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def telemetry_metrics(spark, d):
    return metrics.windowed_counts(t(spark, d, "events"), "ts", "1 hour")


# --- context --------------------------------------------------------------------------------------------------------


def _items(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("selection", "file", "implicit"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return t(spark, d, "documents").select(F.col("lang").alias("conv"), F.col("doc_id").alias("ord"), kind.alias("type"), F.concat("source", F.lit("/"), F.col("doc_id") % 500).alias("file_path"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.col("text").alias("content"))


@query("SELECT lang AS conv, arg_min(source || '/' || (doc_id % 500), doc_id) AS file_path FROM documents WHERE doc_id % 3 = 2 GROUP BY lang")
def cursor_file(spark, d):
    return tables.cursor_file(_items(spark, d))


@query('''WITH i AS (SELECT doc_id AS ord, lang AS conv, ['selection', 'file', 'implicit'][(doc_id % 3 + 1)::INT] AS type, source || '/' || (doc_id % 500) AS file_path, text AS content FROM documents),
x AS (SELECT page_id AS ord, ['en', 'de', 'fr', 'es'][(page_id % 4 + 1)::INT] AS conv, 'src' || page_id % 5 || '/' || page_id % 500 AS file_path, page_id AS a, page_id + page_id % 7 - 1 AS b, url FROM pages)
SELECT ord, conv, type, file_path, content FROM i
UNION ALL SELECT ord, conv, 'selection', file_path, '[行 ' || a || '-' || b || '，共 ' || greatest(1, b - a + 1) || ' 行]' || chr(10) || url FROM x
WHERE NOT EXISTS (FROM i WHERE type = 'selection' AND i.conv = x.conv AND i.file_path = x.file_path)''')
def inline_annotate(spark, d):
    conv = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src"), F.col("page_id") % 5, F.lit("/"), F.col("page_id") % 500)
    last = F.col("page_id") + F.col("page_id") % 7 - 1
    inline = t(spark, d, "pages").select(F.col("page_id").alias("ord"), conv.alias("conv"), path.alias("file_path"), F.col("page_id").alias("start"), last.alias("end"), F.col("url").alias("text"))
    return context.inline_annotate(_items(spark, d), inline)


# --- logs and files -------------------------------------------------------------------------------------------------


#: Lines of a short status without their path, and the status that each means; a line of the last one has no path and is passed over.
_STATES = ((" M", "M"), ("R ", "R"), ("??", "?"), ("MM", "M"), ("AM", "A"), ("UU", "U"), ("T ", "?"), (" D", "D"), ("C ", "C"), ("M", None))


@query(f"""SELECT page_id, {[s for _, s in _STATES[:-1]]}[(page_id % {len(_STATES)} + 1)::INT] AS status,
 CASE WHEN page_id % {len(_STATES)} IN (1, 8) THEN 'b -> ' || url ELSE url END AS path FROM pages WHERE page_id % {len(_STATES)} < {len(_STATES) - 1}""")
def git_status_parse(spark, d):
    k = F.col("page_id") % len(_STATES)
    state = F.element_at(F.array(*[F.lit(s) for s, _ in _STATES]), (k + 1).cast("int"))
    line = F.when(k == len(_STATES) - 1, state).otherwise(F.concat(state, F.lit(" "), F.when(k.isin(1, 8), "a -> b -> ").otherwise(""), "url"))
    return t(spark, d, "pages").select("page_id", logs.git_status_parse(line).alias("r")).filter("r is not null").select("page_id", "r.*")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '测试超时中止（after ' || event_id || '）' WHEN event_type = 'view' THEN '测试全部通过 ✅ (' || floor(value)::BIGINT || ' passed)'
 WHEN event_type = 'click' THEN '测试框架不可用: broken' ELSE '测试存在失败 ❌ (' || floor(value)::BIGINT || ' passed, ' || user_id || ' failed, ' || event_id % 3 || ' errors, 4 skipped)' END AS summary FROM events""")
def test_summary(spark, d):
    e, passed = F.col("event_type"), F.floor("value")
    message = F.when(e == "click", "broken").when(e == "error", F.concat(F.lit("after "), "event_id"))
    return t(spark, d, "events").select("event_id", logs.test_summary(e == "error", e == "view", message, passed, F.col("user_id"), F.col("event_id") % 3, F.lit(4)).alias("summary"))


@query("SELECT doc_id, 1 AS errors, left(text, 2000) AS stdout, true AS timed_out FROM documents")
def timeout_result(spark, d):
    return t(spark, d, "documents").select("doc_id", logs.timeout_result(F.lit("pytest"), F.col("text")).alias("r")).select("doc_id", "r.errors", "r.stdout", "r.timed_out")


def _tests(spark, d) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "python").when(F.col("o_orderstatus") == "P", "javascript")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("project"), kind.alias("kind")).filter("kind is not null")


_TESTS = "x AS (SELECT o_custkey AS project, bool_or(o_orderstatus = 'P') AS js, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1)"


@query(f"WITH {_TESTS} SELECT c_custkey AS project, CASE WHEN js IS NULL THEN 'unknown' WHEN c_custkey % 5 = 0 THEN 'jest' WHEN c_custkey % 5 = 1 AND js THEN 'npm_test' WHEN js THEN 'jest' ELSE 'pytest' END AS framework FROM customer LEFT JOIN x ON project = c_custkey")
def detect_framework(spark, d):
    k = F.col("c_custkey") % 5
    package = F.when(k == 0, '{"devDependencies": {"jest": "1"}}').when(k == 1, '{"scripts": {"test": "node t"}}').when(k == 2, '{"scripts": {"test": ""}}').when(k == 3, "{broken")
    return logs.detect_framework(_tests(spark, d), t(spark, d, "customer").select(F.col("c_custkey").alias("project"), package.alias("package")))


@query(f"WITH {_TESTS} SELECT c_custkey AS project, n IS NOT NULL AS has_tests FROM customer LEFT JOIN x ON project = c_custkey")
def has_tests(spark, d):
    some = _tests(spark, d).select("project").distinct().withColumn("y", F.lit(True))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("project")).join(some, "project", "left").select("project", F.coalesce("y", F.lit(False)).alias("has_tests"))


@query(f"WITH {_TESTS} SELECT c_custkey AS project, c_mktsegment = 'BUILDING' AND n IS NOT NULL AS run FROM customer LEFT JOIN x ON project = c_custkey")
def should_run_tests(spark, d):
    n = _tests(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "project").join(n, "project", "left")
    return c.select("project", logs.should_run_tests(True, F.when(F.col("c_mktsegment") == "BUILDING", "write_file").otherwise("run_command"), F.col("n")).alias("run"))


@query("SELECT 't/test_' || page_id || '.py' AS path, 'python' AS kind FROM pages WHERE page_id % 2 = 0 ORDER BY path LIMIT 500")
def scan_test_files(spark, d):
    folder = F.when(F.col("page_id") % 2 == 0, "t").otherwise("node_modules")
    return tables.scan_test_files(t(spark, d, "pages").select(F.concat(folder, F.lit("/test_"), "page_id", F.lit(".py")).alias("path")))


# --- stores ---------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.when(F.col("label") == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))


@query("SELECT e.vec_id AS q, e.vec_id AS id, 1 AS rank FROM embeddings e WHERE e.vec_id % 20 = 0")
def vec_ivf_self(spark, d):
    """Each twentieth vector, searched for in an index of cells, is its own nearest."""
    path, own = stores.scratch(spark, "ivf"), spread(t(spark, d, "embeddings"))
    centres = search.write_ivf(own, path, "vec_id", "embedding", None)
    queries = own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return search.ivf_search(spark.read.parquet(path), centres, queries, 1, "vec_id", "embedding", 8).select("q", "id", "rank")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 1")
def vec_insert(spark, d):
    path = stores.scratch(spark, "vectors")
    stores.vec_insert(path, _vectors(spark, d), "embedding", 64)
    return spark.read.parquet(path).select("id", "label")


@query("SELECT 0::BIGINT AS n")
def vec_clear(spark, d):
    path = stores.scratch(spark, "vectors")
    stores.vec_insert(path, _vectors(spark, d), "embedding", 64)
    stores.vec_clear(path, spark)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS dropped, false AS again")
def vec_drop(spark, d):
    path = stores.scratch(spark, "vectors")
    stores.vec_insert(path, _vectors(spark, d), "embedding", 64)
    return spark.createDataFrame([(stores.drop_store(spark, path), stores.drop_store(spark, path))], "dropped boolean, again boolean")


@query("SELECT 6::BIGINT AS files_before, 2::BIGINT AS files_after")
def vec_compact(spark, d):
    path, target = stores.scratch(spark, "vectors"), stores.scratch(spark, "compacted")
    t(spark, d, "embeddings").repartition(6).write.parquet(path)
    return stores.vec_compact(spark, path, target, 2)


@query("SELECT p_partkey AS ord, p_name AS name FROM part WHERE p_size >= 25 AND p_partkey % 3 <> 0")
def sink_symbols_json(spark, d):
    path = stores.scratch(spark, "symbols")
    part = t(spark, d, "part").select(F.concat("p_partkey", F.lit(".py")).alias("path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("mtime"), "p_size")
    stores.save_symbols(part.drop("p_size"), path)
    changed = F.col("mtime") + F.when(F.col("ord") % 3 == 0, 1.0).otherwise(0.0)
    return stores.load_symbols(spark, path, part.filter("p_size >= 25").select("path", changed.alias("mtime"), "ord").drop("ord")).select("ord", "name")


@query(f"WITH {_EDGES} SELECT target AS source, source AS target FROM e")
def sink_graph_json(spark, d):
    path = stores.scratch(spark, "graph")
    stores.save_graph(_edges(spark, d), path)
    return stores.load_graph(spark, path)[1].select("source", "target")


@query(f"WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS w FROM d) SELECT w AS term, count(DISTINCT doc_id) AS df FROM p GROUP BY w")
def sink_bm25(spark, d):
    path = stores.scratch(spark, "bm25")
    index = search.write_bm25(spread(t(spark, d, "documents").select("doc_id", "text")), path, "doc_id", "text")
    return index.blocks.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))


@query("SELECT event_id::VARCHAR AS session_id, CASE WHEN length(p) > 500 THEN left(p, 500) || '... (total ' || length(p) || ' chars)' ELSE p END AS output_preview FROM (SELECT event_id, repeat(props, 60) AS p FROM events)")
def sink_audit_jsonl(spark, d):
    path = stores.scratch(spark, "audit")
    calls = t(spark, d, "events").select(F.col("value").alias("ts"), F.col("event_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), F.lit(True).alias("success"), F.col("value").alias("duration_ms"), F.repeat("props", 60).alias("output"))
    tables.write_audit(calls, path)
    return tables.read_audit(spark, path).select("session_id", "output_preview")


@query("SELECT o_orderkey AS goal, o_orderpriority AS raw FROM orders")
def sink_planner_log(spark, d):
    path = stores.scratch(spark, "planner")
    stores.write_planner_log(t(spark, d, "orders").select(F.col("o_orderkey").alias("goal"), F.col("o_orderpriority").alias("raw")), path)
    return spark.read.schema("goal long, raw string").json(path)


@query("SELECT 'w' AS workspace, count(DISTINCT source) AS files, count(*) AS chunks, 'completed' AS status FROM documents")
def sink_index_marker(spark, d):
    path = stores.scratch(spark, "marker")
    stores.write_marker(t(spark, d, "documents").withColumnRenamed("source", "file_path"), path, "w")
    return spark.read.schema("workspace string, files long, chunks long, status string").json(path)


@query("SELECT conv_id, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def sink_sft_jsonl(spark, d):
    path = stores.scratch(spark, "sft")
    stores.write_sft(t(spark, d, "conversations"), path, "conv_id", "turn")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return stores.read_sft(spark, path, "conv_id").select("conv_id", shown.alias("messages"))


@query("WITH e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS at FROM events) SELECT a.user_id, a.event_id AS click_id, b.event_id AS edit_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.at > a.at AND b.at <= a.at + 3600 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def sink_cue_parquet(spark, d):
    e = t(spark, d, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    of = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), "at")
    path = stores.scratch(spark, "cues")
    stores.write_cues(stores.click_then_edit(of("click", "click_id"), of("purchase", "edit_id"), "user_id", 3600), path)
    return spark.read.parquet(path).select("user_id", "click_id", "edit_id")


@query("SELECT count(*) FILTER (event_type <> 'error') AS received, count(*) FILTER (event_type = 'error') AS rejected FROM events")
def src_telemetry(spark, d):
    path = stores.scratch(spark, "telemetry")
    good = F.to_json(F.struct("user_id", "event_type"))
    t(spark, d, "events").select(F.when(F.col("event_type") == "error", "{cut").otherwise(good).alias("value")).write.option("compression", "gzip").text(path)
    bad = F.col("_bad").isNotNull()
    return stores.read_telemetry(spark, path, "user_id long, event_type string").agg(F.sum((~bad).cast("long")).alias("received"), F.sum(bad.cast("long")).alias("rejected"))


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS content FROM part WHERE p_partkey % 4 <> 1")
def incremental_index(spark, d):
    """The files as version -1, and a stream of their changes."""
    from cairn.streaming import jobs

    part = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("content"))
    number = F.col("path").cast("long") % 4
    row = lambda seq, action, content: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), F.lit(content).alias("content"))
    made = F.when(number == 0, F.array(row(1, "modify", "old"), row(2, "modify", "new"))).otherwise(F.array(row(1, "modify", "old"), row(2, "delete", "")))
    index, changed, checkpoint = (stores.scratch(spark, name) for name in ("index", "changes", "checkpoint"))
    part.withColumn("deleted", F.lit(False)).write.parquet(f"{index}/v=-1")
    part.filter(number < 2).select("path", F.inline(made).alias("seq", "action", "content")).write.parquet(changed)
    stream = spark.readStream.schema("path string, seq long, action string, content string").parquet(changed)
    jobs.incremental_index(stream, index, checkpoint).awaitTermination()
    return jobs.read_index(spark, index).select(F.col("path").cast("long").alias("path"), "content")


@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 2 THEN 'q' ELSE 'p' END || p_partkey || '.py' AS path, p_partkey AS k, p_partkey % 4 AS kind, p_size AS n FROM part WHERE p_partkey % 4 <> 1),
c AS (SELECT path, 'f' || k AS symbol_name, 'function' AS chunk_type, 3 AS start_line, 4 + n AS end_line FROM f WHERE kind <> 0
 UNION ALL SELECT path, 'C' || k, 'class', 1, 3 FROM f WHERE kind = 0 UNION ALL SELECT path, 'go', 'function', 2, 3 FROM f WHERE kind = 0
 UNION ALL SELECT path, '__header__', 'import', 1, 1 FROM f WHERE kind <> 0)
SELECT path, left(sha256(path || ':' || symbol_name || ':' || start_line || '-' || end_line), 16) AS id, symbol_name, chunk_type, start_line::INT AS start_line, end_line::INT AS end_line, (SELECT count(*) FROM c) AS documents FROM c""")
def incremental_stores(spark, d):
    """Chunks of a file for each part after two batches: all files, then of every four one rewritten, one deleted and one renamed; and how many documents
    the index counts by its sums."""
    from cairn.sources import segments

    key, number = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    path = F.concat(F.lit("p"), key, F.lit(".py"))
    body = F.array_join(F.array_repeat(F.lit("    x += 1"), F.col("p_size")), "\n")
    first = F.concat(F.lit("import os\n\ndef f"), key, F.lit("(x):\n"), body, F.lit("\n    return x"))
    second = F.concat(F.lit("class C"), key, F.lit(":\n    def go(self):\n        return 1\n"))
    root, part = stores.scratch(spark, "segments"), t(spark, d, "part")
    rows = lambda action, content, new: part.select(path.alias("path"), F.col("p_partkey").alias("ord"), action.alias("action"), content.alias("content"), new.alias("new_path"))
    none = F.lit(None).cast("string")
    segments.apply_batch(spark, root, rows(F.lit("modified"), first, none), 0)
    action = F.when(number == 0, "modified").when(number == 1, "deleted").when(number == 2, "renamed")
    moved = rows(action, F.when(number == 0, second), F.when(number == 2, F.concat(F.lit("q"), key, F.lit(".py"))))
    segments.apply_batch(spark, root, moved.filter("action is not null"), 1)
    total = segments.sums(spark, root, "totals").first().n
    return segments.live(spark, root, "chunks").select("path", "id", "symbol_name", "chunk_type", "start_line", "end_line", F.lit(total).alias("documents"))


@query()
def vec_pq_recall(spark, d):
    """Every 20th vector as a query: its ten nearest others by codes, and which share of the ten nearest by a scan is among them."""
    from cairn.operators import quantised

    every = spread(t(spark, d, "embeddings")).filter("embedding is not null").select("vec_id", "embedding")
    path = stores.scratch(spark, "pq")
    books = quantised.write_pq(every, path, "vec_id", "embedding")
    asked = every.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    near = quantised.pq_search(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), books, asked, 11).filter("q <> id")
    near = near.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank"))).filter("place <= 10")
    # the scan compares the stated queries with all vectors; of eleven, one may be the query itself
    others = search.scan_search(every, asked, 11, "vec_id", "embedding").filter("q <> id")
    exact = others.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank"))).filter("place <= 10").select("q", "id", F.lit(1).alias("hit"))
    return near.join(exact, ["q", "id"], "left").groupBy("q").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / 10, 6).alias("recall"), F.array_sort(F.collect_list("id")).alias("found"))
