"""Every operator bound to the driver's tables, with the same result in SQL where SQL can express it.

The tables hold prose, events and orders, not code; each query states what plays which part.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions import text as X
from cairn.operators import context, graph, logs, metrics, parse, search, session, trigrams
from cairn.plans import fixtures
from cairn.sources import tables
from cairn.sources.scratch import file_states, scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SCHEMAS: dict[tuple, StructType] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; its files are asked for their schema once for each of their states."""
    path = f"{d}/{name}.parquet"
    key = file_states(spark, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOK = rf"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'),
 '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"""
_TERMS = ["license", "released", "license", "dans"]


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return spread(t(spark, d, "documents")).select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query(r"""SELECT doc_id, 'retrieval:5:' || trim(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[。.？?！!，,；;]+$', '')) AS key FROM documents""")
def cache_key(spark, d):
    return t(spark, d, "documents").select("doc_id", X.cache_key(F.col("text"), 5).alias("key"))


@query("SELECT doc_id, left(sha256(source || ':' || lang || ':1-' || n_chars::VARCHAR), 16) AS id FROM documents")
def chunk_id(spark, d):
    return t(spark, d, "documents").select("doc_id", X.chunk_id(F.col("source"), F.col("lang"), F.lit(1), F.col("n_chars")).alias("id"))


@query("SELECT user_id, left(sha256(user_id::VARCHAR), 32) AS user_hash, count(*) AS n FROM events GROUP BY user_id")
def hash_user(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", X.hash_user(F.col("user_id")).alias("user_hash"), "n")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '/{2,}', '/', 'g'), '/(\./)+', '/', 'g'), '(.)/$', '\1') AS path FROM pages""")
def norm_path(spark, d):
    return t(spark, d, "pages").select("page_id", X.norm_path(F.col("url")).alias("path"))


@query(r"""SELECT page_id, regexp_matches(lower(url), '(^|/)tests?(/|$)') OR regexp_matches(lower(url), '(^|/)test[_.][^/]*$') OR regexp_matches(lower(url), '(_test\.|\.test\.)[^/]*$') AS is_test,
 CASE WHEN regexp_matches(url, '\.html$') THEN 'html' ELSE '' END AS kind FROM pages""")
def is_test_file(spark, d):
    return t(spark, d, "pages").select("page_id", X.is_test_file(F.col("url")).alias("is_test"), F.when(F.col("url").rlike(r"\.html$"), "html").otherwise("").alias("kind"))


@query("SELECT page_id, NOT starts_with(p, '/v1/') OR p IN ('/v1/user/usage', '/v1/index/status') OR starts_with(p, '/v1/agent/status') AS exempt FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/v1/user/usage' WHEN page_id % 3 = 1 THEN '/v1/chat' ELSE url END AS p FROM pages)")
def rate_exempt(spark, d):
    p = F.when(F.col("page_id") % 3 == 0, "/v1/user/usage").when(F.col("page_id") % 3 == 1, "/v1/chat").otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", X.rate_exempt(p).alias("exempt"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), least(2, len(string_split(text, chr(10)))), least(4, len(string_split(text, chr(10))))), chr(10)) AS part FROM documents")
def read_lines_range(spark, d):
    return t(spark, d, "documents").select("doc_id", X.read_lines_range(F.col("text"), 2, 4).alias("part"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1333) || chr(10) || '... [diff truncated: ' || (length(text) - 2000) || ' chars omitted] ...' || chr(10) || right(text, 607) ELSE text END AS cut FROM documents")
def truncate_two_thirds(spark, d):
    return t(spark, d, "documents").select("doc_id", X.truncate_two_thirds(F.col("text"), 2000).alias("cut"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 2, 1), len(string_split(text, chr(10)))), chr(10)) AS tail FROM documents")
def truncate_tail_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", X.truncate_tail_lines(F.col("text"), 3).alias("tail"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 AND n > 4 THEN array_to_string(l[1:2], chr(10)) || chr(10) || '... ' || (n - 4)::VARCHAR || ' lines omitted ...' || chr(10) || array_to_string(l[n-1:n], chr(10)) ELSE text END AS cut FROM (SELECT *, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents)")
def read_head_tail(spark, d):
    return t(spark, d, "documents").select("doc_id", X.read_head_tail(F.col("text"), 2000, 2, 2).alias("cut"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '... (total ' || length(text)::VARCHAR || ' chars)' ELSE text END AS preview, length(text) <= 50000 AS allowed FROM documents")
def output_preview(spark, d):
    return t(spark, d, "documents").select("doc_id", X.output_preview(F.col("text")).alias("preview"), (F.length("text") <= 50000).alias("allowed"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def html_escape(spark, d):
    return t(spark, d, "documents").select("doc_id", X.html_escape(F.col("text")).alias("escaped"))


@query("SELECT id, label, context_window, least(floor(context_window * 0.7)::BIGINT, 8000) AS budget FROM (VALUES ('glm-4.5-air', 'GLM-4.5 Air', 128000), ('deepseek-v3', 'DeepSeek V3', 64000), ('gpt-4o', 'GPT-4o', 128000), ('claude-3.5-sonnet', 'Claude 3.5 Sonnet', 200000)) v(id, label, context_window)")
def model_dim(spark, d):
    m = spark.createDataFrame(fixtures.MODELS, "id string, label string, context_window int")
    return m.withColumn("budget", X.compute_budget(F.col("context_window")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a = b OR a = 0 OR b = 0 THEN greatest(a, b)::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END AS lines FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, l_linenumber * 7 AS b FROM lineitem)")
def ref_lines(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.ref_lines(F.col("l_quantity").cast("int"), F.col("l_linenumber") * 7).alias("lines"))


# --- retrieval ----------------------------------------------------------------------------------------------------

_BM25 = f"""
tk AS (SELECT doc_id, {_TOK} AS t FROM documents), d AS (SELECT doc_id, t, len(t) AS dl FROM tk WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS w FROM d) GROUP BY w),
idf AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
q AS (SELECT w, count(*) AS times FROM (SELECT unnest({_TERMS}) AS w) GROUP BY w),
tf AS (SELECT doc_id, dl, q.w, times, len(list_filter(t, lambda x: x = q.w)) AS tf FROM d, q),
s AS (SELECT doc_id, sum(coalesce(CASE WHEN idf < 0 THEN floor ELSE idf END, 0) * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM tf LEFT JOIN idf USING (w), st, fl GROUP BY doc_id)"""


#: Indexes that queries have written, by what they are of.
_WRITTEN: dict[tuple, Any] = {}


def _stored_bm25(spark, d) -> search.Bm25Index:
    """The index of a folder's documents: written by the first query that needs it, and again where the table's files have changed."""
    key = spark.sparkContext.applicationId, file_states(spark, f"{d}/documents.parquet")
    if key not in _WRITTEN:
        _WRITTEN[key] = search.write_bm25(spread(t(spark, d, "documents")), scratch(spark, "bm25"), "doc_id", "text")
    return _WRITTEN[key]


@query(f"WITH {_BM25} SELECT doc_id AS id, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return search.bm25_topk(_stored_bm25(spark, d), _TERMS, 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25}, p AS (SELECT doc_id, unnest(t) AS w FROM d) SELECT w AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS df FROM p GROUP BY w")
def bm25_index(spark, d):
    p = search.postings(spread(t(spark, d, "documents")), "doc_id", "text")
    return p.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


def _query_vector(spark, d) -> list[float]:
    return t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


@query(f"SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM (SELECT e.vec_id AS id, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY distance, id LIMIT 20")
def vec_l2_topk(spark, d):
    top = search.vec_l2_topk(t(spark, d, "embeddings"), _query_vector(spark, d), 20, "vec_id", "embedding")
    return top.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_SYM = "CASE WHEN lower(p_name) = {t} THEN 1.0 WHEN starts_with(lower(p_name), {t}) THEN 0.5 {c} ELSE 0.0 END"


def _sym_sql(contains: bool) -> str:
    part = ", ".join(_SYM.format(t=f"'{w.lower()}'", c=f"WHEN contains(lower(p_name), '{w.lower()}') THEN 0.3" if contains and len(w) >= 3 else "") for w in ["Cold widget", "blue", "Bolt", "zz"])
    return f"SELECT p_partkey, p_name, score::DOUBLE AS score FROM (SELECT *, greatest({part}) AS score FROM part) WHERE score > 0 ORDER BY score DESC, length(p_name), p_partkey LIMIT 20"


_NAMES = ["Cold widget", "blue", "Bolt", "zz"]


def _stored_names(spark, d) -> trigrams.NameIndex:
    key = "names", spark.sparkContext.applicationId, file_states(spark, f"{d}/part.parquet")
    if key not in _WRITTEN:
        _WRITTEN[key] = trigrams.write_names(t(spark, d, "part").select("p_partkey", "p_name"), scratch(spark, "names"), "p_name")
    return _WRITTEN[key]


def _text_files(spark, d) -> DataFrame:
    return spread(t(spark, d, "documents")).select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"))


def _stored_grams(spark, d) -> DataFrame:
    key = "grams", spark.sparkContext.applicationId, file_states(spark, f"{d}/documents.parquet")
    if key not in _WRITTEN:
        _WRITTEN[key] = trigrams.write_grams(_text_files(spark, d), scratch(spark, "grams"), "path", "content")
    return _WRITTEN[key]


@query(_sym_sql(True))
def symbol_match(spark, d):
    return trigrams.name_topk(_stored_names(spark, d), _NAMES, 20, "p_name", ["p_partkey"]).select("p_partkey", "p_name", "score")


@query(_sym_sql(False))
def symbol_suggest(spark, d):
    return trigrams.name_topk(_stored_names(spark, d), _NAMES, 20, "p_name", ["p_partkey"], contains=False).select("p_partkey", "p_name", "score")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower((SELECT n_name FROM nation WHERE n_nationkey = 7)) ORDER BY n_nationkey LIMIT 1")
def symbol_definition(spark, d):
    n = t(spark, d, "nation")
    name = n.filter("n_nationkey = 7").select("n_name").first()[0]
    return search.symbol_definition(n, name, "n_name", "n_nationkey").select("n_nationkey", "n_name")


def _fused(spark, d, k=30):
    docs = t(spark, d, "documents")
    text = search.bm25_topk(_stored_bm25(spark, d), _TERMS, 20)
    vec = search.vec_l2_topk(t(spark, d, "embeddings"), _query_vector(spark, d), 20, "vec_id", "embedding")  # paired by number only
    size = docs.select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(10)
    ranked = search.ranked_list(vec, 0, "vector", [F.col("distance"), F.col("id")]).unionByName(search.ranked_list(text, 1, "bm25", [F.desc(F.round("score", 9)), F.col("id")]))
    ranked = ranked.unionByName(search.ranked_list(size, 2, "symbol", [F.desc("n_chars"), F.col("id")]))
    return search.rrf_fuse(ranked.coalesce(1), k)  # three lists of 20 rows at most


_FUSED = f"""{_BM25},
r AS (SELECT 0 AS o, 'vector' AS path, id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT e.vec_id AS id, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2, 1 LIMIT 20)
 UNION ALL SELECT 1, 'bm25', doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM (SELECT * FROM s WHERE score >= 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20)
 UNION ALL SELECT 2, 'symbol', doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)),
f AS (SELECT id, sum(1 / (60.0 + rank)) AS rrf, min((o, rank)) AS first, string_agg(path, ',' ORDER BY o) AS sources FROM r GROUP BY id),
top AS (SELECT * FROM f ORDER BY round(rrf, 12) DESC, first LIMIT 30)"""


@query(f"WITH {_FUSED} SELECT id, round(rrf, 9) AS rrf_score, sources FROM top")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", ",").alias("sources"))


def _hybrid(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("file_path"))
    found = search.enrich_candidates(_fused(spark, d), docs, ["content", "file_path"])
    return search.rerank_topk(found, search.overlap_score(_TERMS, F.col("content")))


_HYBRID = f"""WITH {_FUSED}, h AS (SELECT top.id, rrf, source AS file_path, len(list_intersect(list_distinct({_TOK}), ['license', 'released', 'dans'])) / 3.0 AS re
 FROM (SELECT * FROM top ORDER BY round(rrf, 12) DESC, id LIMIT 10) top LEFT JOIN documents ON id = doc_id)
SELECT id, file_path, round(re, 6)::DOUBLE AS score, 'reranked' AS status FROM h ORDER BY re DESC, round(rrf, 12) DESC, id LIMIT 5"""


@query(_HYBRID)
def hybrid_topk(spark, d):
    return _hybrid(spark, d).select("id", "file_path", F.round(F.coalesce("rerank_score", "rrf_score"), 6).alias("score"), "status")


@query("""WITH x AS (SELECT item_id, (SELECT count(*) FROM documents WHERE contains(documents.text, benchmark.text)) > 0 AS hit FROM benchmark) SELECT avg(hit::INT::DOUBLE) AS hit_at_k FROM x""")
def hit_at_k(spark, d):
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("passage"))
    holds = search.passages_in(items, spread(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    return search.hit_at_k(items.select("q").join(holds, "q", "left"), holds)


@query("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, min(value) AS min, count(*) FILTER (event_type = 'error') AS errors FROM events")
def latency_report(spark, d):
    r = search.latency_report(t(spark, d, "events"), "value", F.col("event_type") == "error")
    return r.select(*[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")], "max", "min", "errors")


# --- graph --------------------------------------------------------------------------------------------------------

# suppliers import parts, parts call customers' numbers: a graph with names


def _edges(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem")
    up = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct().withColumn("edge_type", F.lit("import"))
    down = li.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("o"), "l_orderkey").alias("target")).distinct().withColumn("edge_type", F.lit("import"))
    return up.unionByName(down)


_EDGES = """e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem
 UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem)"""


@query(f"""WITH RECURSIVE {_EDGES},
b AS (SELECT 's1' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM b JOIN e ON source = node WHERE depth < 2),
c AS (SELECT 'o1' AS node, 0 AS depth UNION SELECT source, depth + 1 FROM c JOIN e ON target = node WHERE depth < 2),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node), n AS (SELECT node, min(depth) AS depth FROM c GROUP BY node)
SELECT m.node, 'upstream' AS direction, m.depth::INT AS depth, min(p.node) AS via
FROM m JOIN e ON target = m.node JOIN m p ON p.node = source AND p.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY ALL
UNION ALL
SELECT n.node, 'downstream', n.depth::INT, min(p.node) FROM n JOIN e ON source = n.node JOIN n p ON p.node = target AND p.depth = n.depth - 1 WHERE n.depth > 0 GROUP BY ALL""")
def graph_bfs(spark, d):
    """What a supplier reaches, and who reaches an order."""
    edges = _edges(spark, d)
    return graph.graph_bfs(edges, "s1", 2, "upstream").unionByName(graph.graph_bfs(edges, "o1", 2, "downstream"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM e) AS import_edges, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) AS call_edges")
def graph_stats(spark, d):
    files = t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file_path"))
    calls = _calls(spark, d).select("source", "target", F.lit("call").alias("edge_type"))
    return graph.graph_stats(_edges(spark, d).unionByName(calls), files)


@query(f"WITH {_EDGES} SELECT source, target, target IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 25) AS resolved FROM e WHERE source = 's1'")
def graph_imports(spark, d):
    files = t(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("file_path"))
    return graph.graph_imports(_edges(spark, d), files, "s1")


@query(f"WITH {_EDGES} SELECT source, target FROM e WHERE source <> 's1' AND target <> 's1'")
def graph_remove_file(spark, d):
    return graph.graph_remove_file(_edges(spark, d), "s1").select("source", "target")


def _calls(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_orderkey", F.lit("::m"), "l_linenumber").alias("source"), F.concat(F.lit("mod.P"), "l_partkey").alias("target"), F.col("l_quantity").cast("int").alias("line"))


_CALLERS = "SELECT 'f' || l_orderkey AS file, 'm' || l_linenumber AS caller, l_quantity::INT AS line, 'mod.P' || l_partkey AS target FROM lineitem WHERE l_partkey = 7 ORDER BY file, line, caller, target LIMIT 20"


@query(_CALLERS)
def find_callers(spark, d):
    return graph.find_callers(_calls(spark, d), "p7")


@query(f"SELECT file, line FROM ({_CALLERS}) WHERE file <> 'f1' AND line >= 1 ORDER BY file, line LIMIT 20")
def cue_suggest(spark, d):
    return graph.cue_suggest(_calls(spark, d), _calls(spark, d), "rename", "p7", "f1")


@query("SELECT 'o' || l_orderkey AS file, l_linenumber AS line, l_returnflag AS name FROM lineitem WHERE lower(l_returnflag) = 'r' AND 'o' || l_orderkey <> 'o1' ORDER BY file, line LIMIT 20")
def find_related_symbols(spark, d):
    s = t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("name"))
    return graph.find_related_symbols(s, "R", "o1")


@query("""WITH s AS (SELECT conv_id AS file, turn AS ord, role AS name, (sum(length(text)) OVER w - length(text))::BIGINT AS a, (sum(length(text)) OVER w)::BIGINT AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT DISTINCT file, (x * 100)::BIGINT AS line FROM s, (VALUES (0), (3), (20)) v(x)) SELECT p.file, line, arg_min(name, ord) AS symbol FROM p JOIN s ON p.file = s.file AND line BETWEEN a AND b GROUP BY ALL""")
def enclosing_symbol(spark, d):
    cum = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    spans = t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.col("role").alias("name"), (cum - F.length("text")).alias("start_line"), cum.alias("end_line"))
    points = spans.select("file").distinct().select("file", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 300, 2000)])).alias("line"))
    return graph.enclosing_symbol(points, spans)


# orders are steps of their customer's plan; each depends on the order before it


def _steps(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    o = t(spark, d, "orders")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), status.alias("status"), F.when(before.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(before)).alias("deps"))


_STEPS = "st AS (SELECT o_custkey AS plan, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dep FROM orders)"


@query("WITH " + _STEPS + " SELECT plan, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in graph.STATUSES) + " FROM st GROUP BY plan")
def step_summary(spark, d):
    return graph.step_summary(_steps(spark, d))


@query(f"WITH {_STEPS} SELECT plan, round(avg((status = 'done')::INT::DOUBLE), 6) AS progress, round_even(100.0 * count(*) FILTER (status = 'done') / count(*), 0)::INT AS percent, bool_and(status IN ('done', 'blocked')) AS all_done, bool_or(status = 'failed') AS any_failed FROM st GROUP BY plan")
def plan_progress(spark, d):
    return graph.plan_progress(_steps(spark, d)).withColumn("progress", F.round("progress", 6))


@query(f"WITH {_STEPS} SELECT a.plan, min(a.id) AS id FROM st a LEFT JOIN st b ON a.plan = b.plan AND a.dep = b.id WHERE a.status = 'pending' AND (a.dep IS NULL OR b.status = 'done') GROUP BY a.plan")
def dag_runnable(spark, d):
    return graph.dag_runnable(_steps(spark, d))


@query("""WITH o AS (SELECT o_custkey AS plan, o_orderkey AS id, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT plan, id, CASE WHEN n = 1 THEN 'self' ELSE 'cycle' END AS violation FROM o WHERE plan % 3 = 0
UNION ALL SELECT plan, id, 'cycle' FROM o WHERE plan % 3 = 1 AND k > 2 AND n > 3
UNION ALL SELECT plan, id, CASE WHEN id % 7 = 0 THEN 'self' ELSE 'missing' END FROM o WHERE plan % 3 = 2 AND (id % 7 = 0 OR id % 5 = 0)""")
def dag_validate(spark, d):
    """Customers' orders as plans. Of every three: a ring of all orders; a way into a ring from the third order on, where there are four; a chain with
    steps that depend on themselves or on none that exists."""
    by = W.partitionBy("plan")
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("id"))
    o = orders.withColumn("k", F.row_number().over(by.orderBy("id"))).withColumn("before", F.lag("id").over(by.orderBy("id"))).withColumn("last", F.max("id").over(by)).withColumn("n", F.count("id").over(by))
    none = F.array().cast("array<bigint>")
    ring = F.array(F.coalesce("before", "last"))
    # the third order depends on the second and the last, so that the ring is entered from outside; a ring of one is left out
    late = F.when(F.col("k") == 3, F.when(F.col("n") > 3, F.array("before", "last")).otherwise(F.array("before"))).otherwise(F.when(F.col("before").isNull(), none).otherwise(F.array("before")))
    loose = F.concat(F.when(F.col("before").isNull(), none).otherwise(F.array("before")), F.when(F.col("id") % 7 == 0, F.array("id")).when(F.col("id") % 5 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(none))
    kind = F.col("plan") % 3
    return graph.dag_validate(o.select("plan", "id", F.when(kind == 0, ring).when(kind == 1, late).otherwise(loose).alias("deps")))


@query(f"WITH {_STEPS} SELECT id, CASE WHEN status = 'pending' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'stopped' END AS reason FROM st")
def fail_remaining(spark, d):
    return graph.fail_remaining(_steps(spark, d), "stopped").select("id", "status", "reason")


@query("WITH l AS (SELECT l_orderkey AS id, l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'pending' WHEN 'N' THEN 'running' ELSE 'done' END AS status FROM lineitem), b AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ord, status) AS before FROM l) SELECT id, ord, before, status FROM b WHERE before <> status AND before || '>' || status NOT IN ('pending>running', 'running>done', 'running>pending')")
def step_transition(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "pending").when(F.col("l_returnflag") == "N", "running").otherwise("done")
    return graph.step_transition(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), status.alias("status"))).select("id", "ord", "before", "status")


# --- sessions -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS x, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1 OR NOT (r = role AND x = text)")
def msg_dedupe(spark, d):
    return session.msg_dedupe(t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("""WITH m AS (SELECT *, row_number() OVER w AS rn, sum(length(text)) OVER w AS cum, coalesce(sum(length(text)) FILTER (role = 'system') OVER (PARTITION BY conv_id), 0) AS sys FROM conversations WINDOW w AS (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC))
SELECT conv_id, turn, role FROM m WHERE role = 'system' OR (rn <= 4 AND floor((sys + cum) / 4) <= 360)""")
def session_trim(spark, d):
    return session.session_trim(t(spark, d, "conversations"), "conv_id", "turn", rounds=2, budget=400).select("conv_id", "turn", "role")


@query("SELECT conv_id, floor(sum(length(text)) / 4)::BIGINT AS tokens, floor(sum(length(text)) FILTER (role = 'assistant') / 4)::BIGINT AS output_tokens FROM conversations GROUP BY conv_id")
def count_tokens(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(X.estimate_tokens(F.sum(F.length("text"))).alias("tokens"), X.estimate_tokens(F.sum(F.when(F.col("role") == "assistant", F.length("text")))).alias("output_tokens"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_query(spark, d):
    return tables.last_message(t(spark, d, "conversations"), "conv_id", "turn", "user")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id")
def merge_system_msgs(spark, d):
    s = t(spark, d, "conversations").filter("role = 'system'").groupBy("conv_id")
    return s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("system"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS batch FROM conversations")
def sse_diff_batches(spark, d):
    return tables.dense_number(t(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "batch")


@query("SELECT left(sha256(user_id::VARCHAR), 32) AS user_hash, ts::DATE AS day, sum(value::BIGINT)::BIGINT AS used, round(least(sum(value::BIGINT) / 500.0, 1.0), 4)::DOUBLE AS percentage, (ts::DATE + 1)::DATE AS reset_at FROM (SELECT user_id, ts, floor(value) AS value FROM events) WHERE value > 0 GROUP BY user_id, ts::DATE")
def quota_usage(spark, d):
    e = t(spark, d, "events").withColumn("n", F.floor("value"))
    return session.quota_usage(e, "user_id", "ts", "n", 500)


@query("""WITH e AS (SELECT *, event_type = 'error' AS f FROM events), g AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT event_id, (sum(f::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id))::BIGINT AS streak, sum(f::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 2 AS fused FROM g""")
def consecutive_failures(spark, d):
    return session.consecutive_failures(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "streak", "fused")


@query("SELECT event_id, coalesce(event_type <> '' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS fused FROM events")
def same_diff_fuse(spark, d):
    return session.same_diff_fuse(t(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "fused")


@query("SELECT event_id, coalesce(a <> b AND b <> event_type AND a <> event_type, false) AS fused FROM (SELECT *, lag(event_type) OVER w AS b, lag(event_type, 2) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def diff_error_fuse(spark, d):
    return session.diff_error_fuse(t(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "fused")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20 AS allowed FROM events")
def repair_budget(spark, d):
    return session.repair_budget(t(spark, d, "events"), "user_id", "event_id").select("event_id", "allowed")


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS n FROM events),
r AS (SELECT user_id, n, t, [t] AS m, [t] AS d, true AS accepted FROM s WHERE n = 0
 UNION ALL SELECT user_id, n, t, CASE WHEN len(m) < 1 THEN list_append(m, t) ELSE m END, CASE WHEN len(m) < 1 AND len(d) < 3 THEN list_append(d, t) ELSE d END, len(m) < 1 AND len(d) < 3
 FROM (SELECT s.user_id, s.n, s.t, list_filter(m, lambda x: x > s.t - 60) AS m, list_filter(d, lambda x: x > s.t - 86400) AS d FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
SELECT user_id, n, t, accepted FROM r""")
def rate_limit(spark, d):
    e = t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return session.rate_limit(e.withColumn("t", F.col("us") / 1e6), "user_id", "t", 1, 3)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS expires, count(*) AS n FROM g GROUP BY user_id, g""")
def session_ttl(spark, d):
    return session.session_ttl(t(spark, d, "events"), "user_id", "ts")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5")
def pubsub_bounded(spark, d):
    return session.latest_rows(t(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS sec, event_type <> 'view' AS writes FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, writes DESC, event_id) AS n FROM e),
r AS (SELECT user_id, n, event_id, sec, writes, CASE WHEN writes THEN event_type END AS value FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.sec, o.writes, CASE WHEN o.writes THEN o.event_type WHEN o.sec - r.sec <= 86400 THEN r.value END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, value FROM r WHERE NOT writes""")
def agent_session_store(spark, d):
    e = t(spark, d, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    writes = e.filter("event_type <> 'view'").select("user_id", "at", F.col("event_type").alias("value"))
    return session.session_store(writes, e.filter("event_type = 'view'").select("user_id", "at", "event_id"), "user_id", "at").select("user_id", "event_id", "value")


@query("SELECT doc_id AS ord, CASE WHEN rn <= 3 THEN CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END END AS observation FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents)")
def react_context(spark, d):
    s = t(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.lit("done").alias("status"), F.col("text").alias("observation"))
    return session.react_context(s, "source", "ord").select("ord", "observation")


@query("""WITH i AS (SELECT user_id AS session, event_id AS token, floor(epoch(ts))::BIGINT AS issued_at FROM events WHERE event_type = 'view'), c AS (SELECT user_id AS session, event_id - 1 AS token, floor(epoch(ts))::BIGINT AS done_at, value > 50 AS allow FROM events)
SELECT i.token, i.session, arg_min(allow, done_at) AS allow FROM i JOIN c USING (session, token) GROUP BY i.token, i.session, issued_at HAVING min(done_at) BETWEEN issued_at AND issued_at + 300""")
def confirm_check(spark, d):
    e = t(spark, d, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    issued = e.filter("event_type = 'view'").select(F.col("user_id").alias("session"), F.col("event_id").alias("token"), F.col("at").alias("issued_at"))
    return session.confirm_check(issued, e.select(F.col("user_id").alias("session"), (F.col("event_id") - 1).alias("token"), "at", (F.col("value") > 50).alias("allow")))


# --- context ------------------------------------------------------------------------------------------------------


def _scored(spark, d) -> DataFrame:
    q = t(spark, d, "labels").select("doc_id", "quality")
    score = (F.coalesce("quality", F.lit(0)) + 0.5).cast("double").alias("score")
    return t(spark, d, "documents").join(q, "doc_id", "left").select(F.col("lang").alias("q"), F.col("doc_id").alias("ord"), F.col("source").alias("file_path"), score, F.floor(F.length("text") / 4).alias("tokens"), "text")


@query("SELECT doc_id AS ord, round((coalesce(quality, 0) + 0.5)::DOUBLE * CASE WHEN lower(source) = 'src3' THEN 1.3 ELSE 1.0 END, 6)::DOUBLE AS position_score FROM documents LEFT JOIN labels USING (doc_id)")
def position_boost(spark, d):
    return context.position_boost(_scored(spark, d), "SRC3").select("ord", F.round("position_score", 6).alias("position_score"))


_ASSEMBLE = "WITH i AS (SELECT lang AS q, doc_id AS ord, coalesce(quality, 0) + 0.5 AS score, floor(length(text) / 4)::BIGINT AS tokens FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER w AS rn, sum(tokens + 40) OVER w AS cum FROM i WINDOW w AS (PARTITION BY q ORDER BY score DESC, ord)), k AS (SELECT * FROM r WHERE cum <= 3000 OR rn = 1)"


@query(_ASSEMBLE + " SELECT q, ord, tokens, rn::INT AS rn FROM k")
def assemble_budget(spark, d):
    return context.assemble_budget(_scored(spark, d), 3000).select("q", "ord", "tokens", "rn")


@query(_ASSEMBLE + " SELECT q, count(*) AS chunks_in, sum(tokens)::BIGINT AS tokens_in, any_value(co) AS chunks_out, any_value(tk) AS tokens_out FROM i JOIN (SELECT q, count(*) AS co, sum(tokens)::BIGINT AS tk FROM k GROUP BY q) USING (q) GROUP BY q")
def assembly_stats(spark, d):
    items = _scored(spark, d)
    return context.assembly_stats(items, context.assemble_budget(items, 3000))


@query("""WITH i AS (SELECT source AS conv, doc_id AS ord, ['selection', 'file', 'implicit'][(doc_id % 3 + 1)::INT] AS type, text, [1, 0, 2][(doc_id % 3 + 1)::INT] AS p, floor(length(text) / 4)::BIGINT AS tokens FROM documents),
c AS (SELECT *, (sum(tokens) OVER w)::BIGINT AS cum FROM i WINDOW w AS (PARTITION BY conv ORDER BY p, ord)), o AS (SELECT *, sum((cum > 9000)::INT) OVER (PARTITION BY conv ORDER BY p, ord) AS over FROM c)
SELECT conv, ord, type, CASE WHEN over = 1 AND length(text) > (9000 - cum + tokens) * 4 THEN left(text, greatest((9000 - cum + tokens) * 4 - 20, 0)) ELSE text END AS content FROM o WHERE over = 0 OR (over = 1 AND type = 'implicit' AND 9000 - cum + tokens > 0)""")
def context_truncate(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("selection", "file", "implicit"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return context.context_truncate(t(spark, d, "documents").select(F.col("source").alias("conv"), F.col("doc_id").alias("ord"), kind.alias("type"), F.col("text").alias("content")), 9000)


@query("""SELECT conv_id AS conv, '<context_files>' || chr(10) || string_agg('<file path="' || role || '" lang="t">' || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</file>', chr(10) ORDER BY turn) || chr(10) || '</context_files>' AS xml FROM conversations GROUP BY conv_id""")
def xml_context(spark, d):
    return context.xml_context(t(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("ord"), F.col("role").alias("path"), F.lit("t").alias("lang"), F.col("text").alias("content")))


@query("""WITH u AS (SELECT source, left(text, 50) AS k FROM documents WHERE lang = 'fr'), i AS (SELECT source, left(text, 50) AS k, min(doc_id) AS ord FROM documents GROUP BY ALL) SELECT source AS file_path, ord FROM i WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source = i.source AND u.k = i.k)""")
def set_dedupe_contexts(spark, d):
    docs = t(spark, d, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("ord"), F.col("text").alias("content"), "lang")
    return context.set_dedupe_contexts(docs, docs.filter("lang = 'fr'")).select("file_path", "ord")


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def context_type_counts(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS path, l_quantity::INT AS added, l_linenumber AS deleted FROM lineitem WHERE l_linenumber = 1), u AS (SELECT l_orderkey AS path, l_quantity::INT AS added, l_linenumber AS deleted FROM lineitem WHERE l_linenumber = 2)
SELECT * FROM s UNION ALL SELECT * FROM u WHERE path NOT IN (SELECT path FROM s)""")
def git_numstat(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_quantity").cast("int").cast("string").alias("added"), F.col("l_linenumber").cast("string").alias("deleted"), "l_linenumber")
    return context.git_numstat(li.filter("l_linenumber = 1"), li.filter("l_linenumber = 2"))


@query()
def compress_chunk(spark, d):
    return t(spark, d, "documents").select("doc_id", context.compress_chunk(F.col("text"), F.lit("function"), F.lit("go"), 6, 2, 2).alias("content"))


# --- logs and files -----------------------------------------------------------------------------------------------


_GREP = r"""WITH l AS (SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT path, line FROM l WHERE regexp_matches(text, 'License') ORDER BY path, line LIMIT 100), r AS (SELECT path, line + x AS line, bool_or(x = 0) AS matched FROM h, (VALUES (-1), (0), (1)) v(x) GROUP BY ALL),
s AS (SELECT path, line, text, matched FROM l JOIN r USING (path, line)), g AS (SELECT *, coalesce((line - lag(line) OVER w > 1)::INT, 0) AS new FROM s WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, line::INT AS line, text, matched, (sum(new) OVER (PARTITION BY path ORDER BY line))::BIGINT AS grp FROM g"""


@query(_GREP)
def grep_context(spark, d):
    return trigrams.grep_context(_text_files(spark, d), "License", 1, 100)


@query(_GREP)
def grep_indexed(spark, d):
    """As grep_context, of the files that have the pattern's trigrams."""
    return trigrams.grep_context(_text_files(spark, d), "License", 1, 100, _stored_grams(spark, d))


@query("""WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT path, l, unnest(range((len(l) - 1) // 10 + 1)) AS k FROM l)
SELECT path, (k * 10 + 1)::INT AS start_line, least((k + 1) * 10, len(l))::INT AS end_line, array_to_string(l[k * 10 + 1 : k * 10 + 10], chr(10)) AS content FROM k""")
def chunk_split_lines(spark, d):
    return parse.chunk_split_lines(t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), 10)


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_quantity::INT AS q, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)),
r AS (SELECT l_orderkey, n, c, CASE WHEN q >= 40 THEN [q] ELSE []::INT[] END AS out, CASE WHEN q >= 40 THEN 0 ELSE q END AS held FROM s WHERE n = 1
 UNION ALL SELECT s.l_orderkey, s.n, s.c, CASE WHEN q >= 40 THEN (CASE WHEN held > 0 THEN list_append(out, held) ELSE out END) || [q] WHEN held + q >= 40 THEN list_append(out, held + q) ELSE out END,
  CASE WHEN q >= 40 OR held + q >= 40 THEN 0 ELSE held + q END FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.n = r.n + 1)
SELECT l_orderkey, array_to_string(CASE WHEN held = 0 THEN out WHEN len(out) = 0 THEN [held] ELSE list_append(out[1:len(out) - 1], out[-1] + held) END, ',') AS merged FROM r WHERE n = c""")
def merge_small_blocks(spark, d):
    sizes = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("int")).alias("sizes"))
    return sizes.select("l_orderkey", F.array_join(parse.merge_small_blocks(F.col("sizes")).cast("array<string>"), ",").alias("merged"))


@query("SELECT page_id AS path FROM pages WHERE octet_length(encode(html)) <= 1048576")
def scan_workspace(spark, d):
    listing = t(spark, d, "pages").select(F.concat("page_id", F.lit(".py")).alias("path"), F.octet_length("html").alias("length"))
    return tables.workspace_files(listing).select(F.regexp_replace("path", r"\.py$", "").cast("bigint").alias("path"))


@query("SELECT doc_id, file_path FROM (SELECT doc_id, source AS file_path FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en') UNION ALL SELECT -doc_id - 1, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en')")
def vec_upsert_file(spark, d):
    old = t(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), "lang")
    fresh = old.filter("file_path in ('src1', 'src2') and lang = 'en'").withColumn("doc_id", -F.col("doc_id") - 1)
    return tables.upsert_files(old.drop("lang"), fresh)


@query("SELECT doc_id FROM documents WHERE source <> 'src1'")
def vec_delete_file(spark, d):
    return tables.delete_file(t(spark, d, "documents"), "src1", "source").select("doc_id")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (1, 3, 5)")
def vec_fetch_ids(spark, d):
    return tables.fetch_ids(t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), [1, 3, 3, 5]).select("id", "label")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid FROM embeddings")
def vec_count(spark, d):
    e = t(spark, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("embedding") == 64).cast("long")).alias("valid"))


@query("WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)) SELECT doc_id, sha256(text) AS content_hash, c.h IS NOT NULL AS hit FROM documents LEFT JOIN c ON c.h = sha256(text)")
def cache_embed(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))  # labelled texts are the ones already embedded
    known = docs.join(t(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.sha2("content", 256).alias("content_hash")).distinct()
    hits, misses = tables.cache_embed(docs, known.select("content_hash", F.lit("m").alias("model"), F.array(F.lit(0.0)).alias("embedding")), "m")
    return hits.select("doc_id", "content_hash", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "content_hash", F.lit(False).alias("hit")))


@query()
def embed_batch(spark, d):
    return t(spark, d, "documents").select("doc_id", tables.feature_hash_embedding(F.col("text"), 64).alias("embedding"))


# --- usage (spec-derived) -------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS shown, count(*) FILTER (event_type = 'click') AS taken, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS rate FROM events GROUP BY user_id")
def adoption_rate(spark, d):
    return metrics.adoption_rate(t(spark, d, "events"), "user_id", "view", "click")


@query("SELECT ts::DATE AS day, count(DISTINCT user_id) AS dau FROM events GROUP BY 1")
def dau(spark, d):
    return metrics.daily_actives(t(spark, d, "events"), "user_id", "ts")


@query("WITH s AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS cohort FROM s) SELECT cohort, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (day - cohort = 1) AS d1, count(DISTINCT user_id) FILTER (day - cohort = 7) AS d7, count(DISTINCT user_id) FILTER (day - cohort = 30) AS d30 FROM g GROUP BY cohort")
def retention(spark, d):
    """From the bits of two parts of the events, merged."""
    e = t(spark, d, "events")
    parts = [metrics.day_bits(e.filter(F.col("event_id") % 2 == k), "user_id", "ts") for k in (0, 1)]
    return metrics.retention(metrics.merge_bits(*parts))


@query("SELECT round(avg(p), 6) AS pass_at_k FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R')::INT::DOUBLE AS p FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey)")
def pass_at_k(spark, d):
    return metrics.pass_at_k(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", 3)


@query("WITH s AS (SELECT avg((quality = 1 - toxic)::INT::DOUBLE) AS po, avg(quality::DOUBLE) AS pa, avg((1 - toxic)::DOUBLE) AS pb FROM labels) SELECT round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM s")
def kappa(spark, d):
    return metrics.kappa(t(spark, d, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")


@query("""WITH h AS (SELECT doc_id, length(text) AS n, ('0x' || left(md5(doc_id || ':0'), 8))::BIGINT AS a, ('0x' || left(md5(doc_id || ':1'), 8))::BIGINT AS b, ('0x' || left(md5(doc_id || ':2'), 8))::BIGINT AS c FROM documents),
x AS (SELECT *, (n * (20 + a % 31) // 100)::BIGINT AS hole FROM h), y AS (SELECT *, ((n - hole) * (b % 101) // 100)::BIGINT AS start FROM x)
SELECT doc_id, ['PSM', 'SPM', 'PMS'][(c % 3 + 1)::INT] AS form, start AS prefix_chars, hole AS hole_chars, (n - start - hole)::BIGINT AS suffix_chars FROM y""")
def fim_split(spark, d):
    return metrics.fim_split(t(spark, d, "documents"), "doc_id", "text")
