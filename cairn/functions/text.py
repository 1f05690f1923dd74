"""Column expressions over text, paths and names; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that full-text search leaves out.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "not", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "to", "of",
    "in", "on", "at", "by", "for", "with", "about", "from", "as", "into", "through", "during", "before", "after",
    "above", "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "only", "own", "same", "so", "than", "too", "very", "just", "because", "but", "if",
    "while", "although", "though", "since", "until", "unless", "however", "therefore", "thus", "def", "return",
    "class", "import", "from", "self", "none", "true", "false", "null", "undefined", "this", "that", "these",
    "those",
)
# Words that are never a symbol's name.
SYMBOL_STOP_WORDS = (
    "the", "a", "an", "and", "or", "not", "is", "are", "was", "were", "be", "been", "to", "of", "in", "on", "at",
    "by", "for", "with", "how", "what", "where", "when", "why", "who", "which", "that", "this", "these", "those",
    "do", "does", "did", "has", "have", "can", "could", "should", "would", "will", "may", "might", "must", "def",
    "class", "import", "from", "self", "true", "false", "none", "null", "undefined", "function", "return", "var",
    "let", "const", "public", "private", "protected", "static", "void", "int", "string", "call", "calls", "called",
    "caller", "callers", "use", "used", "uses", "usage", "where", "find", "who", "谁", "调用", "哪里", "哪个", "哪个函数",
    "哪里用", "谁用",
)
# Extension to language, for indexing and (wider) for display.
INDEX_LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
DISPLAY_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
}
# Commands that are refused, and commands that wait for input.
DANGER_COMMANDS = (r"rm\s+-rf\s+/", r"rm\s+-rf\s+/\*", r"dd\s+if=/dev/zero", r":\(\)\s*\{\s*:\s*\|\s*:&\s*\}\s*;:", r"\bsudo\b")
INTERACTIVE_COMMANDS = (
    r"^\s*npm\s+init\b(?:(?!\s+(-y|--yes)\b).)*$", r"^\s*python\d*\s*(-i\b)?\s*$", r"^\s*node\s*(-i\b)?\s*$", r"^\s*mysql\b.*-p(?:\s|$)",
    r"^\s*ssh\b(?:(?!\s+(-T|-N|-O|host_key_check)\b).)*$", r"^\s*passwd\b", r"^\s*sudo\s+.*-S\b",
)
# Lines that import.
IMPORT_LINES = r"^(import\s|from\s+\S+\s+import|import\s+\{|import\s+\*|import\s+[\"']|import\s+\w+|export\s+|static\s+import|package\s+|require\s*\()"
# Paths that rate limits leave out.
RATE_PREFIX, EXEMPT_PATHS, EXEMPT_PREFIX = "/v1/", ("/v1/user/usage", "/v1/index/status"), "/v1/agent/status"


def tokenize(text: Column) -> Column:
    """Array of search tokens: split at non-word characters, ``HTTPServer``, ``quickSort`` and ``quick_sort`` split, lower
    case, without stop words and single characters. Runs of CJK characters become bigrams."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2")
    cjk = "[\\u4e00-\\u9fff]"
    parts = F.split(F.lower(t), r"[^\p{L}\p{N}]+")
    bigrams = lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.substring(p, i, 2)), lambda b: F.length(b) == 2)
    cut = F.flatten(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.when(p.rlike(cjk), bigrams(p)).otherwise(F.array(p))))
    return F.filter(F.when(t.rlike(cjk), cut).otherwise(parts), lambda p: (F.length(p) > 1) & ~p.isin(*STOP_WORDS))


def normalize_query(q: Column) -> Column:
    q = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(q, F.lit("")), r"\s+", " ")), r"\s+", " "))
    return F.trim(F.regexp_replace(q, r"[。.？?！!，,；;]+$", ""))


def cache_key(q: Column, top_k: int) -> Column:
    return F.concat(F.lit(f"retrieval:{top_k}:"), normalize_query(q))


def chunk_id(path: Column, symbol: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), symbol, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")), 256), 1, 16)


def hash_user(user: Column) -> Column:
    return F.substring(F.sha2(user.cast("string"), 256), 1, 32)


def estimate_tokens(chars: Column) -> Column:
    """Tokens of a whole list of messages, without an encoder: a quarter of its characters, rounded down."""
    return F.floor(chars / 4)


def norm_path(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(\./)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"^(\./)+", "")
    return F.regexp_replace(F.regexp_replace(p, r"/\.$", ""), r"(.)/$", "$1")


def workspace_relative(path: Column, root: str) -> Column:
    """The path below ``root``, or null where it escapes; ``..`` is resolved, links are not."""
    root = root.rstrip("/")
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root + "/"), path))
    walked = F.aggregate(
        F.split(F.regexp_replace(full, r"\\", "/"), "/"), F.array().cast("array<string>"),
        lambda stack, s: F.when(s.isin("", "."), stack).when(s == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, s)),
    )
    flat = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when(flat == root, F.lit(".")).when(F.startswith(flat, F.lit(root + "/")), F.substring(flat, len(root) + 2, 1 << 30))


def path_within(path: Column, root: str) -> Column:
    return workspace_relative(path, root).isNotNull()


def err_norm_path(path: Column, cwd: Column) -> Column:
    below = F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, below), F.substr(path, F.length(below) + 1)).otherwise(path)


def language_of(path: Column, table: dict[str, str], unknown: str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)
    return F.coalesce(found, F.lit(unknown))


def detect_language(path: Column) -> Column:
    return language_of(path, INDEX_LANGUAGES, "unknown")


def detect_language_ext(path: Column) -> Column:
    return language_of(path, DISPLAY_LANGUAGES, "")


def is_test_file(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return p.rlike(r"(^|/)tests?(/|$)") | p.rlike(r"(^|/)test[_.][^/]*$") | p.rlike(r"(_test\.|\.test\.)[^/]*$")


def is_test_file_pat(path: Column) -> Column:
    """The test runner's own rules: python, javascript or null."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    js = r"(^test_.*|\.(test|spec))\.(js|jsx|ts|tsx)$"
    return F.when(base.rlike(r"^test_.*\.py$|_test\.py$"), "python").when(base.rlike(js), "javascript")


def is_import_line(line: Column) -> Column:
    return F.trim(line).rlike(IMPORT_LINES)


# Words that may stand before a definition in brace languages.
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "async", "export", "default")


def is_signature_line(line: Column, language: Column) -> Column:
    s = F.trim(line)
    braces = s.rlike(rf"^(({'|'.join(MODIFIERS)})\s+)*(function|class)\s+") | s.rlike(r"\)\s*\{|=>\s*\{")
    own = ((language == "go") & s.startswith("func ")) | ((language == "rust") & s.startswith("fn ")) | ((language == "ruby") & s.startswith("def "))
    return F.when(language == "python", s.rlike(r"^(async\s+)?def\s+") | s.startswith("class ")).otherwise(braces | own)


def is_comment_line(line: Column, language: Column) -> Column:
    s = F.trim(line)
    quoted = (language == "python") & (s.startswith('"""') | s.startswith("'''"))
    return (s != "") & (s.startswith("/*") | s.startswith("*") | quoted | F.when(language.isin("python", "ruby"), s.startswith("#")).otherwise(s.startswith("//")))


def match_call_target(target: Column, name: Column) -> Column:
    return (F.lower(target) == F.lower(name)) | F.endswith(F.lower(target), F.concat(F.lit("."), F.lower(name)))


def looks_local_module(module: Column, language: Column) -> Column:
    return F.when(language.isin("javascript", "typescript"), module.rlike(r"^[./]")).when(language == "python", (module != "") & ~module.startswith("_")).otherwise(F.lit(False))


def is_danger_cmd(cmd: Column) -> Column:
    return cmd.rlike("|".join(f"(?:{p})" for p in DANGER_COMMANDS))


def is_interactive_cmd(cmd: Column) -> Column:
    return cmd.rlike("|".join(f"(?:{p})" for p in INTERACTIVE_COMMANDS))


def rate_exempt(path: Column) -> Column:
    return ~F.startswith(path, F.lit(RATE_PREFIX)) | path.isin(*EXEMPT_PATHS) | F.startswith(path, F.lit(EXEMPT_PREFIX))


def symbol_tokens(q: Column) -> Column:
    tags = F.regexp_extract_all(q, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))
    names = F.filter(F.regexp_extract_all(q, F.lit(r"([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1)), lambda t: ~F.lower(t).isin(*SYMBOL_STOP_WORDS))
    return F.array_distinct(F.concat(tags, names))


def tail_slice(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def read_lines_range(text: Column, start: int, end: int) -> Column:
    """Lines start..end (1-based, inclusive), clamped to the text."""
    lines = F.split(text, "\n", -1)
    lo = F.least(F.greatest(F.lit(start), F.lit(1)), F.size(lines))
    hi = F.least(F.greatest(F.lit(end), lo), F.size(lines))
    return F.array_join(F.slice(lines, lo, hi - lo + 1), "\n")


def read_head_tail(text: Column, limit: int, head: int, tail: int) -> Column:
    """Texts of more than ``limit`` bytes: first and last lines around a marker."""
    lines = F.split(text, "\n", -1)
    omitted = F.size(lines) - head - tail
    cut = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n... "), omitted.cast("string"), F.lit(" lines omitted ...\n"), F.array_join(tail_slice(lines, tail), "\n"))
    return F.when((F.octet_length(text) > limit) & (omitted > 0), cut).otherwise(text)


def truncate_tail_lines(text: Column, n: int = 50) -> Column:
    return F.array_join(tail_slice(F.split(text, "\n", -1), n), "\n")


def truncate_two_thirds(text: Column, limit: int = 8000) -> Column:
    """Texts of more than ``limit`` characters: the first two thirds, how far the text is over the limit, and what is left for its end."""
    head = limit * 2 // 3
    tail = max(limit - head - 60, 0)
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n... [diff truncated: "), (F.length(text) - limit).cast("string"), F.lit(" chars omitted] ...\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def truncate_text_tokens(text: Column, tokens: Column) -> Column:
    return F.when(F.length(text) <= tokens * 4, text).otherwise(F.left(text, F.greatest(tokens * 4 - 20, F.lit(0)).cast("int")))


def output_preview(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("... (total "), F.length(text).cast("string"), F.lit(" chars)"))).otherwise(text)


def ref_lines(start: Column, end: Column) -> Column:
    one = F.greatest(start, end).cast("string")
    return F.when((start == end) | (start == 0) | (end == 0), one).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))


def compute_budget(window: Column, ratio: float = 0.7, most: int = 8000) -> Column:
    return F.coalesce(F.least(F.floor(window * ratio), F.lit(most).cast("long")), F.lit(most).cast("long"))


def diff_context_lines(old: Column, new: Column) -> Column:
    longer = F.when(F.length(old) >= F.length(new), old).otherwise(new)
    return F.when(F.size(F.split(longer, "\n", -1)) > 500, 3).otherwise(1000)


def html_escape(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_greedy(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` where it parses as JSON, else null; code fences are dropped."""
    cut = F.regexp_extract(F.regexp_replace(text, r"```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when((cut != "") & F.try_parse_json(cut).isNotNull(), cut)


def sanitize_request_id(value: Column, most: int = 64) -> Column:
    return F.left(F.nullif(F.trim(value), F.lit("")), F.lit(most))


def rg_norm(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\\", "/"), r"^\./", "")


def anonymize(text: Column) -> Column:
    """Spec-derived: comments dropped, names of six or more letters replaced by ``id``."""
    return F.regexp_replace(F.regexp_replace(text, r"(#|//)[^\n]*", ""), r"(?<!\w)[A-Za-z_]{6,}(?!\w)", "id")


def snippet_guard(text: Column, most: int = 50_000) -> Column:
    return F.length(text) <= most


def project_status(processed: Column, total: Column) -> Column:
    """Progress to four places; 0 where there is nothing to do."""
    return F.when(total > 0, F.round(processed / total, 4)).otherwise(0.0)


def filter_recent(mtime: Column, now: Column, months: int) -> Column:
    """Whether a file (mtime in seconds) changed within ``months`` of 30 days; 0 months or an unknown time: yes."""
    return F.lit(True) if months <= 0 else F.coalesce(mtime >= now - months * 30 * 86400, F.lit(True))
