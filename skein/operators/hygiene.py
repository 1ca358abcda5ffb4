"""Duplicates, ingestion flags, audits and the join of per-paper metrics."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.python import sequence_ratio
from skein.operators import graph


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the newest; ties to the last of all columns."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    return newest(stored.unionByName(new, allowMissingColumns=True), key, at)


def unprocessed(files: DataFrame, papers: DataFrame) -> DataFrame:
    """files (file_path, mtime) without those ingested since, with a summary and an embedding."""
    done = papers.where("summary IS NOT NULL AND trim(summary) <> '' AND size(embedding) > 0").select("file_path", "ingested_at")
    f, d = files.alias("f"), done.alias("d")
    return f.join(d, (F.col("f.file_path") == F.col("d.file_path")) & (F.col("d.ingested_at") >= F.col("f.mtime")), "left_anti")


def ingestion_flags(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Papers with their quality flags; most flags first, then the longest text."""
    c = chunks.groupBy("paper_id").agg(F.sum(F.length("text")).alias("text_length"), F.count("*").alias("chunk_count"))
    p = papers.join(c, "paper_id", "left").select("paper_id", "title", "summary", "year", F.col("page_count") if "page_count" in papers.columns else F.lit(None).cast("int").alias("page_count"), F.coalesce("text_length", F.lit(0)).alias("text_length"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    low = F.when(F.col("page_count") > 0, F.col("text_length") < 300 * F.col("page_count")).otherwise(F.col("text_length") < 1200)
    flags = F.array_compact(F.array(F.when(size("title") < 5, "missing_title"), F.when(F.col("year").isNull(), "missing_year"), F.when(F.col("chunk_count") == 0, "missing_chunks"), F.when(size("summary") < 60, "short_summary"), F.when(low, "low_text_yield")))
    return p.select("paper_id", flags.alias("flags"), "text_length", "chunk_count")


def flag_totals(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def title_similarity(a, b):
    """.65 Jaccard of tokens + .35 sequence ratio."""
    return 0.65 * T.jaccard(T.token_set(a), T.token_set(b)) + 0.35 * sequence_ratio(F.lower(T.collapse(a)), F.lower(T.collapse(b)))


def duplicate_pairs(neighbours: DataFrame, papers: DataFrame, cosine: float = 0.965, title: float = 0.82, compat: bool = False) -> DataFrame:
    """a < b, cosine, title_similarity, page_delta (null where a page count is unknown): of neighbour pairs either way (compat: only from the lesser id's list)."""
    near = neighbours.where(F.col("score") >= cosine)
    if compat:
        near = near.where("src < dst")
    pairs = near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("score").alias("cosine"))
    pages = F.col("page_count") if "page_count" in papers.columns else F.lit(None).cast("int")
    of = lambda n: papers.select(F.col("paper_id").alias(n), F.col("title").alias(f"t{n}"), pages.alias(f"p{n}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("title_similarity", title_similarity(F.col("ta"), F.col("tb")))
    return both.where(F.col("title_similarity") >= title).select("a", "b", "cosine", "title_similarity", F.abs(F.col("pa") - F.col("pb")).alias("page_delta"))


def top_duplicates(pairs: DataFrame, limit: int | None = 120) -> DataFrame:
    """The most similar pairs first."""
    ordered = pairs.orderBy(F.desc("cosine"), F.desc("title_similarity"), "a", "b")
    return ordered if limit is None else ordered.limit(limit)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    c = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return c.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))


def merge_metrics(base: DataFrame, sources: list[DataFrame], key: str = "paper_id") -> DataFrame:
    """Optional per-paper metrics joined onto the base, which keeps all its rows."""
    return reduce(lambda left, right: left.join(right, key, "left"), sources, base)


def structural_consensus(metrics: DataFrame) -> DataFrame:
    """.6 z of degree + .4 z of eigenvector centrality; total adds .2 claim and .2 cluster consensus; roles by strength."""
    s = 0.6 * F.coalesce("z_degree", F.lit(0.0)) + 0.4 * F.coalesce("z_eigen", F.lit(0.0))
    out, into = F.coalesce("out_strength", F.lit(0.0)), F.coalesce("in_strength", F.lit(0.0))
    return metrics.withColumns({"structural_consensus": s, "consensus_total": 0.6 * s + 0.2 * F.coalesce("claim_consensus", F.lit(0.0)) + 0.2 * F.coalesce("cluster_consensus", F.lit(0.0)), "source_role": out / (out + into + 1e-6), "sink_role": into / (out + into + 1e-6), "bridge_role": F.least(out, into) / (out + into + 1e-6)})


def audit(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """paper_id, kind of every broken rule: takeaways, placeholders, markup, missing notes, score ranges."""
    n = F.size(F.coalesce("takeaways", F.array().cast("array<string>")))
    rules = {
        "takeaway_count": (n < 3) | (n > 5),
        "placeholder": F.exists("takeaways", lambda s: F.lower(s).rlike(r"\b(?:placeholder|takeaway [0-9])\b")),
        "bold_markup": F.exists("takeaways", lambda s: s.contains("****")),
        "score_range": (F.col("usability") < 0) | (F.col("usability") > 10),
    }
    each = papers.select("paper_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("kind"))
    return each.unionByName(papers.join(notes.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.lit("missing_note").alias("kind")))


def corpus_version(files: DataFrame) -> DataFrame:
    """djb2 modulo 2^64 over "path|vN", joined by two bars in order of path.

    The hash of two texts laid end to end is a * 33^len(b) + b, so each range of sorted files is
    folded in its own task and only a row for each range is put together on the driver.
    """
    spark = files.sparkSession
    named = files.select("file_path", "version", F.concat("file_path", F.lit("|v"), F.col("version").cast("string")).alias("t"))
    ordered = named.repartitionByRange("file_path", "version").sortWithinPartitions("file_path", "version").select(F.spark_partition_id().alias("part"), "t")

    def fold(batches):
        part, h, power = None, 0, 1
        for b in batches:
            for p, t in zip(b["part"], b["t"]):
                text = t if part is None else "||" + t
                part = p
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
                powers = np.concatenate(([np.uint64(1)], np.full(len(codes), np.uint64(33)))).cumprod(dtype=np.uint64)
                h = (h * int(powers[-1]) + int((codes * powers[:-1][::-1]).sum(dtype=np.uint64))) % 2**64
                power = power * int(powers[-1]) % 2**64
        if part is not None:
            yield pd.DataFrame({"part": [part], "h": [str(h)], "power": [str(power)]})

    value, first = 5381, True
    for r in sorted(ordered.mapInPandas(fold, "part int, h string, power string").collect(), key=lambda r: r["part"]):
        bars = value if first else (value * 33 + 124) * 33 + 124
        value, first = (bars * int(r["power"]) + int(r["h"])) % 2**64, False
    return spark.createDataFrame([(str(value),)], "version string")
