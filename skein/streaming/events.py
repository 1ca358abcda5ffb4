"""Event counts, read scores and reading sessions over a stream of events: event_id, ts, event_type, paper_id."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Event time as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ), each event id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return watermarked(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def read_scores(events: DataFrame) -> DataFrame:
    """Running opens, notes and score of each paper; for update or complete mode."""
    c = events.groupBy("paper_id").agg(F.count_if(F.col("event_type") == "opened").alias("opens"), F.count_if(F.col("event_type") == "note_saved").alias("notes"))
    return c.withColumn("read_score", F.least(F.lit(1.0), 1 - F.exp(-(0.55 * F.col("opens") + 0.9 * F.col("notes")))))


def question_counts(events: DataFrame) -> DataFrame:
    """Running asked and answered counts of each question."""
    q = F.lower(F.trim("q"))
    return events.where("q IS NOT NULL").groupBy(q.alias("question")).agg(F.count_if(F.col("event_type") == "qa_question").alias("asked"), F.count_if(F.col("event_type") == "qa_answer_ready").alias("answered"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Reading sessions of each paper, ended by a gap."""
    return watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "paper_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paper_id", "n")


def run_to_end(query_input: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for tests and small results."""
    w = query_input.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return query_input.sparkSession.table(name)
