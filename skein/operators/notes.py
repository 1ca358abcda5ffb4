"""Notes and written texts: which are stale or broken, strategies, pins, panels, debates, bridges."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vector as V
from skein.operators import hygiene

VERSION = 2


def notes_of(notes: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, path: the first Markdown file whose name holds the id, in either case; ids without one are left out."""
    name = F.upper(F.regexp_extract("path", "[^/]*$", 0))
    token = F.regexp_extract(name, r"\[([^\]]*)\][^\[\]]*$", 1)  # names end in the id in brackets
    n = notes.select("path", name.alias("name"), token.alias("token")).where("name LIKE '%.MD'")
    exact = n.join(ids.select(key, F.upper(F.col(key).cast("string")).alias("token")), "token").select(key, "path")
    return exact.groupBy(key).agg(F.min("path").alias("path"))


def stale_notes(items: DataFrame, notes: DataFrame, version: int = VERSION, key: str = "paper_id") -> DataFrame:
    """key, reason of items whose note is missing, of an older format, or doesn't link its present cluster.

    items: key, link; notes: key, text.
    """
    j = items.join(notes.select(key, "text"), key, "left")
    reason = F.when(F.col("text").isNull(), "missing").when(~F.contains("text", F.lit(f"format_version: {version}\n")), "old_format").when(F.col("link").isNotNull() & ~F.contains("text", "link"), "changed_link")
    return j.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def note_findings(notes: DataFrame, version: int = VERSION, limit: int | None = 250) -> DataFrame:
    """path, kind of every broken rule of notes (path, folder, text), in order of path; the report shows the first 250."""
    has = lambda s: F.contains("text", F.lit(s))
    rules = {"missing_markers": ~(has("<!-- begin -->") & has("<!-- end -->")), "missing_format_version": ~has(f"format_version: {version}"), "missing_meta": (F.col("folder") == "papers") & ~has("> [!info] Meta")}
    found = notes.select("path", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("kind"))
    return found if limit is None else found.orderBy("path", "kind").limit(limit)


def failures(failed: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, title (the id where it is unknown), error; in order of title, whatever its case."""
    j = failed.join(papers.select("paper_id", "title"), "paper_id", "left").select("paper_id", F.coalesce("title", F.col("paper_id").cast("string")).alias("title"), "error")
    return j.orderBy(F.lower("title"), "paper_id")


def strategies_from(papers: DataFrame, now: Column) -> DataFrame:
    """A strategy for each paper: its verdict as idea, else the first sentence of its blueprint, else of its summary."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    hypotheses = F.filter(F.transform("hypotheses", lambda h: F.trim(h)), lambda h: h != "")
    return papers.select(F.concat(F.lit("strategy-"), F.col("paper_id").cast("string")).alias("strategy_id"), F.coalesce(blank(F.col("title")), F.lit("Strategy project")).alias("title"), F.array(F.col("paper_id").cast("string")).alias("paper_ids"), F.coalesce(blank(F.col("verdict")), blank(T.first_sentence(F.col("blueprint"))), T.first_sentence(F.col("summary"))).alias("idea"), hypotheses.alias("hypotheses"), F.col("trading_tags").alias("tags"), now.alias("updated_at"))


def updated(strategies: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Strategies with changed or new ones put in, whose time of change is now."""
    return hygiene.upsert(strategies, changes.withColumn("updated_at", now), "strategy_id", "updated_at")


def deleted(strategies: DataFrame, ids: DataFrame) -> DataFrame:
    return strategies.join(ids.select("strategy_id"), "strategy_id", "left_anti")


def toggled(pins: DataFrame, ids: DataFrame) -> DataFrame:
    """Pinned ids after each of ids was toggled as often as it occurs."""
    odd = ids.groupBy("cluster_id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("cluster_id")
    return pins.select("cluster_id").distinct().join(odd, "cluster_id", "left_anti").unionByName(odd.join(pins, "cluster_id", "left_anti"))


def renamed(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """clusters (level, cluster_id, name, summary, name_source) with names and summaries set at either level; a blank name changes nothing."""
    c = changes.select("cluster_id", F.trim("name").alias("new_name"), F.col("summary").alias("new_summary")).where("new_name <> ''")
    j = clusters.join(c, "cluster_id", "left")
    return j.select(*[F.coalesce("new_name", "name").alias("name") if k == "name" else F.coalesce("new_summary", "summary").alias("summary") if k == "summary" else F.when(F.col("new_name").isNotNull(), "manual").otherwise(F.col("name_source")).alias("name_source") if k == "name_source" else F.col(k) for k in clusters.columns])


def galaxy_export(clusters: DataFrame, pins: DataFrame) -> DataFrame:
    """Clusters with their pin, pinned ones first, then by level and id."""
    p = clusters.join(pins.select("cluster_id", F.lit(True).alias("pinned")), "cluster_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return p.orderBy(F.desc("pinned"), "level", "cluster_id")


def bridge(clusters: DataFrame, key: str) -> DataFrame:
    """key, title, abstract, embedding of a paper that would join the clusters (cluster_id, name, summary, centroid) of each key."""
    some = F.array_sort(F.collect_list(F.struct("cluster_id", "name", "summary")))
    rows = clusters.groupBy(key).agg(some.alias("c"))
    names, seeds = F.transform("c", lambda s: s["name"]), F.filter(F.transform("c", lambda s: s["summary"]), lambda s: F.coalesce(s, F.lit("")) != "")
    abstract = F.concat(F.lit("This paper would bridge "), F.array_join(names, ", "), F.lit("."), F.when(F.size(seeds) > 0, F.concat(F.lit(" It builds on: "), F.array_join(seeds, " "))).otherwise(""))
    vectors = V.mean_vectors(clusters.where("size(centroid) > 0"), [key], column="centroid", out="v").select(key, V.unit(F.col("v")).alias("embedding"))
    return rows.select(key, F.concat(F.lit("Bridge: "), F.array_join(names, " × ")).alias("title"), abstract.alias("abstract")).join(vectors, key, "left")


def panel(clusters: DataFrame, papers: DataFrame, speakers: int = 3) -> DataFrame:
    """cluster_id, panel: what the first papers of each cluster claim, each answering the one before.

    clusters: cluster_id, name; papers: paper_id, cluster_id, title, claim.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct("paper_id", "title", "claim"))), 1, speakers)
    p = papers.groupBy("cluster_id").agg(first.alias("p"))
    number = lambda i: (i + 1).cast("string")
    says = lambda s, i: F.concat(F.lit("Author "), number(i), F.lit(" ("), s["title"], F.lit("): "), s["claim"], F.when(i > 0, F.concat(F.lit("\nAuthor "), number(i), F.lit(" answers Author "), i.cast("string"), F.lit(" on its assumptions."))).otherwise(""))
    text = F.when(F.col("p").isNull(), F.concat(F.lit("No papers for "), "name", F.lit("."))).otherwise(F.array_join(F.concat(F.array(F.concat(F.lit("Panel on "), "name")), F.transform("p", says)), "\n"))
    return clusters.join(p, "cluster_id", "left").select("cluster_id", text.alias("panel"))


TURNS = ["opening: {}", "rebuttal: which assumptions of the other side may fail", "cross-examination: which metric and regime carry the evidence", "closing: where it is of use, and its risks"]


def debate(pairs: DataFrame, rounds: int = 4) -> DataFrame:
    """pairs (id, a, b of title and summary) with the text of a debate of 2 to 8 rounds of four kinds in turn."""
    rounds = max(2, min(8, rounds))
    lines = [F.concat(F.lit("Debate: "), "a.title", F.lit(" vs "), "b.title"), F.lit(f"Rounds: {rounds}")]
    for r in range(rounds):
        lines.append(F.lit(f"Round {r + 1}"))
        for side in ("a", "b"):
            head, _, tail = TURNS[r % 4].partition("{}")
            said = T.first_sentence(F.col(f"{side}.summary")) if r % 4 == 0 else F.lit("")
            lines.append(F.concat(F.lit(f"{side.upper()} ("), f"{side}.title", F.lit(f") {head}"), said, F.lit(tail)))
    return pairs.select("id", F.array_join(F.array(*lines), "\n").alias("debate"))


def _bullets(chunks, most: int) -> str:
    """Numbered, clipped chunks within `most` characters: shorter ones first, then fewer, from both ends inwards."""
    flat = [" ".join((c or "").split()) for c in chunks]
    n = len(flat)
    if not n:
        return ""
    clip = lambda s, k: s if len(s) <= k else s[: k - 1].rstrip() + "…"
    show = lambda some, k: "\n".join(f"Chunk {i + 1}: {clip(flat[i], k)}" for i in some)
    width = max(80, min(480, most // n - 16))
    text = show(range(n), width)
    while len(text) > most and width > 60:
        width = max(60, int(width * 0.85))
        text = show(range(n), width)
    if len(text) <= most:
        return text
    chosen: list[int] = []
    for i in (k for pair in zip(range(n), reversed(range(n))) for k in pair):
        if i not in chosen and len(show(sorted([*chosen, i]), width)) <= most:
            chosen = sorted([*chosen, i])
    return show(chosen, width) if chosen else clip(text, most)


def chunk_bullets(most: int):
    """A function of an array column of chunk summaries that gives their bullets."""

    def run(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: _bullets([] if c is None else list(c), most))

    return F.pandas_udf(run, "string")
