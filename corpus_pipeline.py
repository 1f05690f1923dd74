"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.bpe import digests, encode_documents
from cairn.llm.common import materialize, release, table, written
from cairn.llm.exact_dedup import drop_exact_copies
from cairn.llm.mixing import mix_documents
from cairn.llm.quality import drop_low_quality, fit
from cairn.llm.simhash import drop_similar_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; fitted on the labelled rows of this stage's input."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return drop_low_quality(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash finds candidates, an exact five-word Jaccard similarity of 0.8 decides."""
    return drop_similar_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids: their number, digest, and the digest of the decoded bytes."""
    return digests(encode_documents(docs, keep=["doc_id"]))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: SQL cannot express the trained classifier, the fingerprints or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark)  # what the stage wrote on its way, and the stage's input
    return STAGES[-1][1](spark, docs, sf_dir)
