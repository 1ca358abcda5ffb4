"""The synthetic tables seen as papers, texts, reading events and edges.

SQL has the same expressions for the oracle, as common table expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import spread

EVENT_TYPES = {"view": "opened", "click": "note_saved", "purchase": "rec_helpful", "error": "rec_not_helpful", "signup": "qa_question"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, cluster_id, year, embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").alias("cluster_id"), (F.lit(2000) + F.col("vec_id") % 20).cast("int").alias("year"), "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title (the first line), summary, topic, lang, year."""
    return spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("paper_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), F.col("source").alias("topic"), "lang", (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, paper_id, event_type of the reading log, value, props."""
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("event_type")]
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("paper_id"), kind.alias("event_type"), "value", "props")


def priority_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a yearly series: cluster_id (the priority), year."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cluster_id"), F.year("o_orderdate").alias("year"))


SQL_PAPERS = "papers AS (SELECT vec_id AS paper_id, label AS cluster_id, CAST(2000 + vec_id % 20 AS INTEGER) AS year, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
SQL_TEXTS = "texts AS (SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS summary, source AS topic, lang, CAST(2000 + doc_id % 20 AS INTEGER) AS year FROM documents)"
SQL_EVENTS = "log AS (SELECT event_id, ts, user_id AS paper_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items()) + " END AS event_type, value, props FROM events)"
SQL_SERIES = "series AS (SELECT o_orderpriority AS cluster_id, year(o_orderdate) AS year FROM orders)"
