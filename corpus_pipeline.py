"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of documents; the last adds the packing. Between stages the documents are
written as Parquet in the shared folder and read again, so a lost executor costs one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import langid, packing, quality, secrets, simhash
from skein.llm.common import materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a language of the labelled sample; text of no language goes."""
    return langid.keep_identified(docs, langid.train(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on the labels of these documents, accepts."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least doc_id."""
    return simhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by their rule's name."""
    return secrets.redact(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket and batch of every remaining document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_batches),
]

# Trained classifiers and fingerprints can't be written in SQL; tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
