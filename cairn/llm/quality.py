"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates
and scored as sparse dot products.

Features are hashed n-grams, each counted relative to the text's number of words: the lower-cased words' unigrams and
bigrams, and unigrams, bigrams and trigrams of words reduced to their form (letters by case, digits, signs, repeats
collapsed), which carry over to words that training never saw; a word that repeats its neighbour is a form of its own.
The model is fitted on at most ``MAX_TRAIN_ROWS`` labelled rows (those whose hashed ids are smallest): a bounded
sample. Scoring reads every whole text where it lies, without a shuffle.

Defined results: null text is empty; texts without words score by the bias and one feature of their own. Labels
other than 0 and 1, null labels and labels of ids without a document are not learnt from; a document
labelled twice is learnt from once per distinct label. Without labelled rows every score is 0.5. Rows that repeat are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import free_name, freeing, id_crc_mod, quoted, table, text_of

#: Labelled rows that training reads at most; the table of weights has 2**LOG2 entries.
MAX_TRAIN_ROWS, LOG2, EPOCHS = 8000, 18, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.3

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_FORM = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)


_REPEATS = re.compile(rb"(?s)(.)\1+")


def _form(word: bytes) -> bytes:
    """Case, digits and signs of a whole word, repeats collapsed; bytes beyond ASCII count as small letters."""
    return _REPEATS.sub(rb"\1", word.translate(_FORM))


class Forms:
    """Hashes of words and of their forms; the cache is emptied when it grows large."""

    def __init__(self, most: int = 300_000):
        self.seen, self.most = {}, most

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w.lower()) << 32 | zlib.crc32(b"f" + _form(w))
        both = np.fromiter(map(seen.__getitem__, words), "u8", len(words))
        return both >> _U(32), both & _U(0xFFFFFFFF)


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    return (((h + _U(salt)) * _MIX) >> _U(64 - LOG2)).astype("u4")


def features(word: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Slots of a text's n-grams, with repeats."""
    if not len(word):
        return _spread(np.zeros(1, "u8"), 99)
    again = np.concatenate(([False], word[1:] == word[:-1]))
    form = np.where(again, form + _U(7), form)
    two = form[:-1] * _U(31) + form[1:]
    return np.concatenate((
        _spread(word, 1), _spread(word[:-1] * _U(31) + word[1:], 2), _spread(form, 3), _spread(two, 4), _spread(two[:-1] * _U(31) + form[2:], 5),
    ))


def _words(texts: pd.Series) -> Iterator[list[bytes]]:
    """One text's words at a time: a whole batch's words would fill a worker's memory."""
    return (t.encode().split() for t in texts)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over (slots, values, label) rows, in the order given, EPOCHS times."""
    z, n = np.zeros(1 << LOG2), np.zeros(1 << LOG2)
    bias, bias_n = 0.0, 0.0
    for _ in range(EPOCHS):
        for slots, values, label in rows:
            zi, ni = z[slots], n[slots]
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ values + bias, -35, 35)))
            g = (p - label) * values
            z[slots] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[slots] = ni + g * g
            bias_n += (p - label) ** 2
            bias -= ALPHA * (p - label) / (BETA + np.sqrt(bias_n))
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype("f4"), float(bias)


def _sparse(slots: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots, and the square roots of their relative counts: long texts weigh as short ones."""
    u, c = np.unique(slots, return_counts=True)
    return u, np.sqrt(c / max(1, words))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, y) of at most MAX_TRAIN_ROWS labelled rows that are not held out: of rows that share an id, the one with the least text. The sample is drawn
    from ids alone and broadcast (its size is bounded), so of the texts only the sample's are shuffled."""
    order = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))
    marks = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("y"))
    marks = marks.filter((id_crc_mod("id", 5) != 0) & F.col("y").isin(0, 1)).select("id", F.col("y").cast("int").alias("y")).distinct()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("t"))
    drawn = rows.select("id").distinct().join(marks, "id").orderBy(order, "id", "y").limit(MAX_TRAIN_ROWS)
    return rows.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("t").alias("t")).select(order.alias("k"), "t", "y")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Train on ``training_sample``: one task makes the features, trains, and hands back the weights (2**LOG2 numbers)."""
    sample = training_sample(docs, labels, label_col, id_col, text_col).repartition(1).sortWithinPartitions("k", "y", "t")

    @freeing
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, rows = Forms(), []
        for batch in batches:
            for words, y in zip(_words(batch["t"]), batch["y"], strict=True):
                slots, values = _sparse(features(*forms(words)), len(words))
                rows.append((slots, values.astype("f4"), int(y)))
        if not rows:
            return
        w, bias = train(rows)
        yield pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    got = sample.mapInPandas(learn, "w binary, bias double").collect()
    return (np.frombuffer(got[0]["w"], "f4").copy(), got[0]["bias"]) if got else (np.zeros(1 << LOG2, "f4"), 0.0)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """``docs`` with the score behind the other columns: ``columns[-1]``, which is ``score_col``, or that with underscores behind
    it where ``docs`` has a column of the name."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1]))

    @freeing
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias, forms = np.frombuffer(shared.value[0], "f4"), shared.value[1], Forms()
        for texts in batches:
            out = np.zeros(len(texts))
            for k, words in enumerate(_words(texts)):
                slots, values = _sparse(features(*forms(words)), len(words))
                out[k] = w[slots] @ values + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(free_name(docs.columns, score_col), F.pandas_udf(score, "double")(text_of(quoted(text_col))))


def drop_low_quality(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns."""
    scored = score_documents(docs, model, text_col)
    score = scored.columns[-1]
    return scored.filter(F.col(quoted(score)) >= threshold).drop(score)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", (id_crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"),
        F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
