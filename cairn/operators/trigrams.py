"""Trigrams: which texts may hold a string or match a regular expression, from a stored table of three-character pieces."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.search import FEW, local_rows, symbol_scores

FILE_ROWS = 2_000_000

#: A pattern's need: a trigram; ("and" or "or", needs); or None, that anything may match.
Need = str | tuple | None


def grams_of(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def write_grams(rows: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(gram, id) for each trigram of each row's text. Each partition's rows are written by the task that has them, sorted by gram in files of bounded
    size, so that a reader's grams prune files and pages; nothing is shuffled, and texts are read once."""
    flat = rows.select(F.explode(grams_of(F.col(text_col))).alias("gram"), F.col(id_col).alias("id"))
    flat.sortWithinPartitions("gram", "id").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return rows.sparkSession.read.parquet(path)


def literal_need(text: str) -> Need:
    low = text.lower()
    return _join("and", sorted({low[k : k + 3] for k in range(len(low) - 2)}))


def pattern_need(pattern: str) -> Need:
    """What trigrams a line must have to match. Literals in a row must all be there, of branches one; what may be absent needs nothing. A pattern that this
    reader does not follow, or without three literals in a row, may match anything, and every text has to be searched."""
    try:
        return _need(P.parse(pattern))
    except (re.error, NotImplementedError, OverflowError):
        return None


def _join(kind: str, needs: list[Need]) -> Need:
    if kind == "or" and any(n is None for n in needs):
        return None
    needs = [n for n in needs if n is not None]
    if kind == "and":
        needs = [x for n in needs for x in (n[1] if isinstance(n, tuple) and n[0] == "and" else [n])]
    return (kind, needs) if len(needs) > 1 else needs[0] if needs else None


def _need(tokens) -> Need:
    found, run = [], ""

    def flush() -> None:
        nonlocal run
        found.append(literal_need(run))
        run = ""

    for op, value in tokens:
        if op is C.LITERAL:
            run += chr(value)
            continue
        if op is C.AT:  # takes no character, but what stands around it need not touch in the pattern's reading
            flush()
            continue
        flush()
        if op is C.SUBPATTERN:
            found.append(_need(value[3]))
        elif op is C.BRANCH:
            found.append(_join("or", [_need(b) for b in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_need(value[2]))
        elif op is C.ATOMIC_GROUP:
            found.append(_need(value))
    flush()
    return _join("and", found)


def _all(need: Need) -> set[str]:
    return {need} if isinstance(need, str) else set().union(*map(_all, need[1]))


def _holds(need: Need, own: Column) -> Column:
    if isinstance(need, str):
        return F.array_contains(own, need)
    out = _holds(need[1][0], own)
    for n in need[1][1:]:
        out = out & _holds(n, own) if need[0] == "and" else out | _holds(n, own)
    return out


def candidates(index: DataFrame, need: Need) -> DataFrame:
    """Ids of the texts that have what is needed: one shuffle of the needed grams' rows."""
    wanted = index.filter(F.col("gram").isin(*sorted(_all(need))))
    return wanted.groupBy("id").agg(F.collect_set("gram").alias("own")).filter(_holds(need, F.col("own"))).select("id")


def grep_context(files: DataFrame, pattern: str, n: int = 2, most: int = 100, index: DataFrame | None = None) -> DataFrame:
    """(path, line, text, matched, grp): matching lines of ``files`` (path, content) with n lines around; ranges that
    overlap or touch are one group. At most ``most`` matches in all, in the order of path and line. With ``index`` (``write_grams`` of the files by path) only
    files that have the pattern's trigrams are searched; a pattern without any is looked for in all. Files are cut into lines where they lie, and
    only lines that are shown leave them."""
    need = pattern_need(pattern) if index is not None else None
    some = files if need is None else files.join(candidates(index, need).withColumnRenamed("id", "path"), "path", "left_semi")
    lines = F.split("content", "\n", -1)
    numbers = F.filter(F.transform(lines, lambda x, k: F.when(x.rlike(pattern), k + 1)), lambda k: k.isNotNull())
    hits = some.select("path", F.explode(numbers).alias("line")).orderBy("path", "line").limit(most)
    hits = F.broadcast(hits.groupBy("path").agg(F.sort_array(F.collect_list("line")).alias("hits")))  # at most ``most`` rows
    found = files.join(hits, "path").select("path", "hits", lines.alias("lines"))
    around = F.flatten(F.transform("hits", lambda h: F.sequence(F.greatest(h - n, F.lit(1)), F.least(h + n, F.size("lines")))))
    shown = F.array_sort(F.array_distinct(around))
    # a line begins a group where the one before it is not shown
    starts = F.filter(F.col("shown"), lambda w: ~F.array_contains(F.col("shown"), w - 1))

    def row(w: Column) -> Column:
        group = F.size(F.filter(F.col("starts"), lambda s: s <= w)) - 1
        return F.struct(w.alias("line"), F.get(F.col("lines"), w - 1).alias("text"), F.array_contains(F.col("hits"), w).alias("matched"), group.cast("long").alias("grp"))

    cut = found.withColumn("shown", shown).withColumn("starts", starts)
    return cut.select("path", F.inline(F.transform("shown", row)))


class NameIndex(NamedTuple):
    """Rows with their lower-cased name (low), sorted by it; and the names' trigrams."""

    names: DataFrame
    grams: DataFrame


def write_names(symbols: DataFrame, path: str, name: str) -> NameIndex:
    low = symbols.withColumn("low", F.lower(F.col(name)))
    files = max(1, -(-low.count() // FILE_ROWS))
    low.repartitionByRange(files, "low").sortWithinPartitions("low").write.mode("overwrite").parquet(f"{path}/names")
    spark = symbols.sparkSession
    names = spark.read.parquet(f"{path}/names")
    return NameIndex(names, write_grams(names.select("low").distinct(), f"{path}/grams", "low", "low"))


def read_names(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/grams"))


def _after(prefix: str) -> str | None:
    """The least string behind all that begin with ``prefix``."""
    for k in range(len(prefix) - 1, -1, -1):
        if prefix[k] < chr(0xD7FF):
            return prefix[:k] + chr(ord(prefix[k]) + 1)
    return None


def name_topk(index: NameIndex, tokens: list[str], k: int, name: str, tie: list[str], contains: bool = True) -> DataFrame:
    """As ``symbol_topk`` from a stored index. Names that a token begins lie together and are found by ranges; since they stand before those that
    a token is only within, the trigrams are asked only where there are fewer than k of them."""
    order, low = [F.desc("score"), F.length(name), *tie], F.col("low")
    wanted = F.lit(False)
    for t in {t.lower() for t in tokens}:
        end = _after(t)
        wanted = wanted | ((low >= t) & (low < end) if end else low >= t)
    first = symbol_scores(index.names.filter(wanted), tokens, name, contains).drop("low").orderBy(*order).limit(k)
    inner = [n for t in tokens if len(t) >= 3 and (n := literal_need(t))] if contains else []
    if not inner or k > FEW:
        return first if not inner else symbol_scores(index.names, tokens, name, contains).drop("low").orderBy(*order).limit(k)
    rows = first.collect()
    if sum(r.score >= 0.5 for r in rows) >= k:
        return local_rows(first, rows)
    also = candidates(index.grams, ("or", inner)).withColumnRenamed("id", "low")
    rest = index.names.filter(~wanted).join(also, "low", "left_semi")
    return symbol_scores(index.names.filter(wanted).unionByName(rest), tokens, name, contains).drop("low").orderBy(*order).limit(k)
