"""Context packing: boost, compress, cut to a token budget, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X

TYPE_PRIORITY = {"file": 0, "selection": 1, "implicit": 2}


def position_boost(items: DataFrame, cursor: str, factor: float = 1.3) -> DataFrame:
    same = F.lower(F.regexp_replace("file_path", r"\\", "/")) == cursor.replace("\\", "/").lower()
    return items.withColumn("position_score", F.col("score") * F.when(same, factor).otherwise(1.0))


def compress_chunk(content: Column, chunk_type: Column, language: Column, lines: int = 100, head: int = 10, tail: int = 10) -> Column:
    """Functions and classes of more than ``lines`` lines: signature, the docstring or comments below it, ``head`` and
    ``tail`` lines of the body around a marker. Lines before the signature are left out."""
    all_ = F.split(content, "\n", -1)
    flags = F.transform(all_, lambda x: X.is_signature_line(x, language))
    sig = F.greatest(F.array_position(flags, True), F.lit(1)).cast("int")
    after = F.slice(all_, sig + 1, F.size(all_))
    quote = F.left(F.trim(F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))), F.lit(3))
    opens = (language == "python") & quote.isin('"""', "'''")
    closing = F.array_position(F.transform(F.slice(after, 2, F.size(all_)), lambda x: F.contains(x, quote)), True).cast("int")
    closed_at = F.when(F.size(F.split(F.get(after, F.lit(0)), quote, -1)) >= 3, 1).when(closing > 0, closing + 1).otherwise(F.size(after))
    doc = F.when(opens, closed_at).otherwise(0)
    rest = F.slice(after, doc + 1, F.size(all_))
    stop = F.array_position(F.transform(rest, lambda x: X.is_comment_line(x, language)), False).cast("int")
    notes = doc + F.when(stop > 0, stop - 1).otherwise(F.size(rest))
    body = F.slice(after, notes + 1, F.size(all_))
    omitted = F.size(body) - head - tail
    prefix = F.when(language.isin("python", "ruby"), "#").otherwise("//")
    marker = F.concat(prefix, F.lit(" ... 省略 "), omitted.cast("string"), F.lit(" 行 ..."))
    parts = F.concat(F.array(F.element_at(all_, sig)), F.slice(after, F.lit(1), notes), F.slice(body, 1, head), F.array(marker), X.tail_slice(body, tail))
    return F.when(chunk_type.isin("function", "class") & (F.size(all_) > lines) & (omitted > 0), F.array_join(parts, "\n")).otherwise(content)


def context_truncate(items: DataFrame, budget: int) -> DataFrame:
    """Items (conv, ord, type, content) in the order of their type's priority, while their tokens fit; the first that
    does not fit ends the list, but an implicit one is cut to what is left. (conv, ord, type) names an item."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv]), F.col("type")), F.lit(9))
    w = W.partitionBy("conv").orderBy("p", "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the windows see numbers only; of the items, those that stay meet them again
    sizes = items.select("conv", "ord", "type", priority.alias("p"), F.floor(F.length("content") / 4).alias("tokens"))
    run = sizes.withColumn("cum", F.sum("tokens").over(w)).withColumn("over", F.sum((F.col("cum") > budget).cast("int")).over(w))
    left = F.lit(budget) - (F.col("cum") - F.col("tokens"))
    kept = run.filter((F.col("over") == 0) | ((F.col("over") == 1) & (F.col("type") == "implicit") & (left > 0)))
    kept = kept.select(F.col("conv").alias("c"), F.col("ord").alias("o"), F.col("type").alias("y"), F.when(F.col("over") == 1, left).alias("left"))
    both = items.join(kept, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ord") == F.col("o")) & F.col("type").eqNullSafe(F.col("y")))
    content = F.when(F.col("left").isNotNull(), X.truncate_text_tokens(F.col("content"), F.col("left"))).otherwise(F.col("content"))
    return both.select("conv", "ord", "type", content.alias("content"))


def assemble_budget(items: DataFrame, budget: int, overhead: int = 40) -> DataFrame:
    """Per query (q) the best items whose tokens and overhead fit; the best one stays in any case."""
    w = W.partitionBy("q").orderBy(F.desc("score"), "ord")
    run = items.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum(F.col("tokens") + overhead).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return run.filter((F.col("cum") <= budget) | (F.col("rn") == 1)).drop("cum")


def assembly_stats(items: DataFrame, kept: DataFrame) -> DataFrame:
    before = items.groupBy("q").agg(F.count(F.lit(1)).alias("chunks_in"), F.sum("tokens").alias("tokens_in"))
    return before.join(kept.groupBy("q").agg(F.count(F.lit(1)).alias("chunks_out"), F.sum("tokens").alias("tokens_out")), "q")


def xml_context(items: DataFrame) -> DataFrame:
    """Per conversation one ``<context_files>`` text of its items in order."""
    one = F.concat(F.lit('<file path="'), X.html_escape(F.col("path"), True), F.lit('" lang="'), F.col("lang"), F.lit('">\n'), X.html_escape(F.col("content")), F.lit("\n</file>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("x")))), lambda s: s["x"])
    return items.groupBy("conv").agg(F.concat(F.lit("<context_files>\n"), F.array_join(parts, "\n"), F.lit("\n</context_files>")).alias("xml"))


def set_dedupe_contexts(items: DataFrame, user: DataFrame) -> DataFrame:
    """Items that no user context has, by path and first 50 characters, and of equal ones the first."""
    key = F.left("content", F.lit(50))
    fresh = items.withColumn("k", key).join(user.select("file_path", key.alias("k")).distinct(), ["file_path", "k"], "left_anti")
    return fresh.groupBy("file_path", "k").agg(F.min_by("content", "ord").alias("content"), F.min("ord").alias("ord")).drop("k")


def inline_annotate(items: DataFrame, inline: DataFrame) -> DataFrame:
    """``items`` (conv, ord, type, file_path, content) and, behind them, the inline selections (conv, ord, file_path, start, end, text) as
    selection items with their range of lines before the text; not where the conversation has a selection of the file."""
    chosen = items.filter("type = 'selection'").select("conv", "file_path").distinct()
    count = F.greatest(F.lit(1), F.col("end") - F.col("start") + 1).cast("string")
    prefix = F.concat(F.lit("[行 "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("，共 "), count, F.lit(" 行]\n"))
    added = inline.join(chosen, ["conv", "file_path"], "left_anti").select("conv", "ord", F.lit("selection").alias("type"), "file_path", F.concat(prefix, "text").alias("content"))
    return items.select("conv", "ord", "type", "file_path", "content").unionByName(added)


def git_numstat(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """(path, added, deleted); staged numbers win, ``-`` counts as 0."""
    n = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0)).alias(c)
    s, u = (d.select("path", n("added"), n("deleted")) for d in (staged, unstaged))
    return s.unionByName(u.join(s.select("path"), "path", "left_anti"))
