"""The registered queries of this package and their DuckDB equivalents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import ann, bpe, langid, packing, pii, pq, quality, secrets, simhash, tokencounts
from skein.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.document_token_counts(read_table(spark, sf_dir, "documents"))


def routed_neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over partitions of 25 vectors against the exact neighbours."""
    return ann.recall(read_table(spark, sf_dir, "embeddings"))


def near_pairs_over_many_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of op9 over lists of about 16 vectors and a wider threshold, so that probing is put to the test on small tables."""
    return pq.near_pairs(read_table(spark, sf_dir, "embeddings"), threshold=0.4, rows_per_list=16)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_secret_scan, op3_language_id, op4_pii, op5_bpe_codec, op6_nearest_neighbours, op7_simhash_near_dedup, op8_packing, op9_embedding_near_dedup, op10_token_counts, routed_neighbours_recall, near_pairs_over_many_lists)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.oracle_sql(),
        "op6_nearest_neighbours": ann.oracle_sql(),
        "op8_packing": packing.oracle_sql(),
        "op9_embedding_near_dedup": pq.groups_sql(),
        "routed_neighbours_recall": ann.recall_sql(),
        "near_pairs_over_many_lists": pq.oracle_sql(0.4),
    }
