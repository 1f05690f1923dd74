"""URL filters: host word segmentation, then naive Bayes.

Rules on (host, path prefix) decide first. The other urls are judged by a multinomial naive Bayes over words: hosts are cut
at what is no letter, and concatenated names are segmented by unigram Viterbi; paths are cut at what is no letter. The unigrams
are the letter runs of WORD_LETTERS of all pages' visible text, of all paths and of hyphenated hosts. The classifier is trained
here, on every distinct url of the table, from positive and unlabelled examples: urls that a rule blocks, and those that no rule decides and whose host has
one of TOPICS standing by itself (free-bets), are one class; all others, most of which are fine, the other. So a url that no rule decides is blocked
where its words are those of blocked urls, not for lack of evidence; and a name in which such words are run together (freecasinobets) is
blocked through its segments, since as a whole no url has taught it.

Nothing grows on the driver and nothing is broadcast: words, their counts and odds are tables. Each distinct run of letters in
a host is segmented once, from those of its substrings that the table of words has; each distinct url is judged once.

Defined results: null urls and urls without ``://`` have empty host and path and no rule; an empty list of words has the
score of the prior odds. Repeated urls are judged alike; without any blocked url nothing else is blocked. An empty table gives an
empty result. Only the columns named are read, whatever the names of others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import freeing, materialize, quoted, table

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that a host names what it offers by; a host that has one between its hyphens and dots is an example of what is to be blocked.
TOPICS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "casino", "casinos", "escort", "jackpot", "loans", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
#: Letters that a word of the unigram model has, at least and at most: longer runs are names to be segmented, not words.
WORD_LETTERS = (2, 30)
#: Added to each class's count of each word.
SMOOTHING = 0.5


def split_url(url: str) -> tuple["F.Column", "F.Column"]:
    """Host and path columns of a url column, as RULES use them; A-Z of the host are lower-cased."""
    after = F.when(F.instr(F.col(quoted(url)), "://") > 0, F.expr(f"substring({quoted(url)}, instr({quoted(url)}, '://') + 3)"))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: "F.Column", path: "F.Column", rules=RULES) -> tuple["F.Column", "F.Column"]:
    """The longest rule that fits (text of host and prefix), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class HostWords:
    """Unigram Viterbi: the split of a run of letters with the highest product of word probabilities."""

    def __init__(self, total: int):
        self.total = total or 1

    def known(self, count: int) -> float:
        return math.log10(count / self.total)

    def unknown(self, n: int) -> float:
        return -math.log10(self.total) - n  # ten times less likely with each letter

    def split(self, run: str, counts: dict[str, int]) -> list[str]:
        """``counts`` has at least the run's substrings that are words."""
        log = {w: self.known(c) for w, c in counts.items() if c > 0}
        longest = max(map(len, log), default=1)
        best, back = [0.0], [0]
        # an unknown word may have any length; its letters cost alike, so the best place to open one is kept as we go
        opened = (0.0, 0)
        for end in range(1, len(run) + 1):
            opened = max(opened, (best[end - 1] + end - 1, -(end - 1)))
            top = (opened[0] - math.log10(self.total) - end, opened[1])
            for a in range(max(0, end - longest), end):
                if (w := run[a:end]) in log:
                    top = max(top, (best[a] + log[w], -a))
            best.append(top[0])
            back.append(-top[1])
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]


def _runs(text: "F.Column") -> "F.Column":
    """Runs of the letters a to z, in order; other letters separate."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def word_counts(pages: DataFrame, url: str = "url", html: str | None = None) -> DataFrame:
    """Written: (word, n) of all words of the pages' texts without tags, of all paths and of hyphenated hosts."""
    host, path = split_url(url)
    parts = [F.when(F.contains(host, F.lit("-")), host), path]
    if html is not None:
        parts.append(F.regexp_replace(F.coalesce(F.col(quoted(html)).cast("string"), F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(_runs(F.concat_ws("/", *parts))).alias("word"))
    return materialize(words.filter(F.length("word").between(*WORD_LETTERS)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "unigrams")


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of each distinct ``run``: its substrings meet the table of words, and Viterbi chooses among those found."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    low, high = WORD_LETTERS
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    rest = F.length("run") - F.col("start") + 1
    ends = starts.filter(rest >= low).select("run", "start", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), rest))).alias("letters"))
    pieces = ends.select("run", F.call_function("substring", "run", "start", "letters").alias("word")).distinct()
    found = pieces.join(counts, "word").groupBy("run").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))

    @freeing
    def split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = HostWords(total)
        for run, words, n in batches:
            yield pd.Series([model.split(r, {} if w is None else dict(zip(w, c, strict=True))) for r, w, c in zip(run, words, n, strict=True)])

    whole = runs.join(found, "run", "left")
    return whole.select("run", F.pandas_udf(split, "array<string>")("run", "words", "counts").alias("words"))


def url_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """Written: (url, host, path, words) of distinct ``urls`` (url, host, path): the host's segmented words, then the path's."""
    hosts = urls.select("host").distinct().select("host", F.posexplode(_runs(F.col("host"))).alias("at", "run"))
    cut = materialize(segment(hosts.select("run").distinct(), counts), "segmented")
    own = hosts.join(cut, "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("runs"))
    own = materialize(own.select("host", F.flatten("runs.words").alias("host_words")), "hosts")
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("host_words", none), _runs(F.col("path")))
    return materialize(urls.join(own, "host", "left").select("url", "host", "path", words.alias("words")), "url-words")


def train(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Of (words, block): (word, odds), the log odds of block of each word; and the prior log odds."""
    classes = labelled.groupBy("block").agg(F.count(F.lit(1)).alias("urls"), F.sum(F.size("words")).alias("words")).collect()
    urls, words = ({r["block"]: r[c] for r in classes} for c in ("urls", "words"))
    each = labelled.select("block", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a"))
    each = materialize(each, "classes")
    size = each.count()
    log = lambda n, own: F.log((n + SMOOTHING) / (words.get(own, 0) + SMOOTHING * size))
    prior = math.log((urls.get(True, 0) + SMOOTHING) / (urls.get(False, 0) + SMOOTHING))
    return each.select("word", (log(F.col("b"), True) - log(F.col("a"), False)).alias("odds")), prior


def score(urls: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """``urls`` (url, words, ...) with the log odds of block. A word that training never saw says nothing."""
    each = urls.select("url", F.posexplode("words").alias("at", "word")).join(odds, "word")
    # added in the order of the words, so that reruns agree to the last digit
    sums = each.groupBy(F.col("url").alias("scored")).agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("w"))
    total = F.aggregate("w", F.lit(float(prior)), lambda x, y: x + y["odds"])
    sums = sums.select("scored", total.alias("score"))
    return urls.join(sums, F.col("url") == F.col("scored"), "left").drop("scored").withColumn("score", F.coalesce("score", F.lit(float(prior))))


def judge_urls(pages: DataFrame, url: str = "url", html: str | None = None, rules=RULES, topics=TOPICS) -> DataFrame:
    """One row per distinct url of ``pages`` (null counts as empty): url, host, path, rule, verdict, words and score (log odds of block)."""
    counts = word_counts(pages, url, html)
    urls = pages.select(F.coalesce(F.col(quoted(url)).cast("string"), F.lit("")).alias("url")).distinct()
    host, path = split_url("url")
    known = url_words(urls.select("url", host.alias("host"), path.alias("path")), counts)
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    named = F.arrays_overlap(_runs(F.col("host")), F.array(*map(F.lit, topics)).cast("array<string>"))
    odds, prior = train(known.select("words", F.coalesce(decided == "block", named).alias("block")))
    judged = score(known, odds, prior)
    verdict = F.coalesce(decided, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("url", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "words", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = materialize(judge_urls(pages, html="html"), "judged").withColumnRenamed("url", "judged_url")
    own = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))
    return own.join(judged, F.col("url") == F.col("judged_url")).select("page_id", "host", "path", "rule", "verdict", "words", "score")
