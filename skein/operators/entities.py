"""Entities in texts, their adoption over years, flashcards, prompts and answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

DATASET_CUES = "benchmark|catalog|corpus|data from|dataset|observations from|survey".split("|")


def metric_counts(t: Column) -> Column:
    """array of (name, n) of the metric names a text contains; a name inside another counts for both."""
    low = F.lower(F.coalesce(t, F.lit("")))
    upper = ("auc", "auroc", "bleu")
    each = [F.struct(F.lit(m.upper() if m in upper else m).alias("name"), F.regexp_count(low, F.lit(m)).alias("n")) for m in T.METRICS]
    return F.filter(F.array(*each), lambda s: s["n"] > 0)


def acronyms(t: Column) -> Column:
    """array of (name, kind): capital words of three or more; the 60 characters around the first place tell dataset from method."""
    t = F.coalesce(t, F.lit(""))
    names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]{2,}(?![\p{L}\p{N}_])"), 0))

    def kind(name: Column) -> Column:
        at = F.position(name, t)
        near = F.substr(t, F.greatest(at - 60, F.lit(1)), F.length(name) + 120)
        return F.struct(name.alias("name"), F.when(T.has_any(near, DATASET_CUES), "dataset").otherwise("method").alias("kind"))

    return F.transform(names, kind)


def entities(texts: DataFrame, id_col: str = "paper_id", top: int = 6) -> DataFrame:
    """id, kind (metric, dataset or method), name: at most `top` of each kind in order of count and name."""
    t = F.col("text")
    metrics = texts.select(id_col, F.explode(metric_counts(t)).alias("e")).select(id_col, F.lit("metric").alias("kind"), F.col("e.name").alias("name"), F.col("e.n").alias("n"))
    named = texts.select(id_col, t, F.explode(acronyms(t)).alias("e")).select(id_col, F.col("e.kind").alias("kind"), F.col("e.name").alias("name"), F.regexp_count("text", F.col("e.name")).alias("n"))
    w = Window.partitionBy(id_col, "kind").orderBy(F.desc("n"), "name")
    return metrics.unionByName(named).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def adoption(found: DataFrame, papers: DataFrame, top: int = 40) -> DataFrame:
    """kind, name, year, n of the most adopted entities of each kind."""
    total = found.groupBy("kind", "name").agg(F.countDistinct("paper_id").alias("papers"))
    w = Window.partitionBy("kind").orderBy(F.desc("papers"), "name")
    best = total.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("kind", "name")
    return found.join(best, ["kind", "name"], "left_semi").join(papers.select("paper_id", "year"), "paper_id").where("year IS NOT NULL").groupBy("kind", "name", "year").agg(F.countDistinct("paper_id").alias("n"))


def flashcards(answers: DataFrame) -> DataFrame:
    """id, ord, question, answer of texts with Q: and A: lines; lines without marks pair up."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    marked = F.exists(lines, lambda s: s.rlike(r"(?i)^q\s*[:.]"))
    each = answers.select("id", F.posexplode(F.when(marked, F.filter(lines, lambda s: s.rlike(r"(?i)^[qa]\s*[:.]"))).otherwise(lines)).alias("i", "line"), marked.alias("marked"))
    w = Window.partitionBy("id").orderBy("i")
    body = F.trim(F.regexp_replace("line", r"(?i)^[qa]\s*[:.]\s*", ""))
    number = F.when(F.col("marked"), F.sum(F.col("line").rlike(r"(?i)^q\s*[:.]").cast("int")).over(w)).otherwise(F.floor(F.col("i") / 2) + 1)
    question = F.when(F.col("marked"), F.col("line").rlike(r"(?i)^q\s*[:.]")).otherwise(F.col("i") % 2 == 0)
    cards = each.withColumns({"ord": number, "q": question, "body": body}).where("ord > 0").groupBy("id", "ord").agg(F.min_by(F.when(F.col("q"), F.col("body")), F.when(F.col("q"), F.col("i"))).alias("question"), F.min_by(F.when(~F.col("q"), F.col("body")), F.when(~F.col("q"), F.col("i"))).alias("answer"))
    return cards.where("question IS NOT NULL AND answer IS NOT NULL")


def context(chunks: DataFrame, budget: int, key: str = "paper_id") -> DataFrame:
    """The chunks of each key in order while their running length stays within the budget."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget)


def missing_points(answer: Column, keywords: Column, assumptions: Column) -> Column:
    """Keywords and assumptions that an answer doesn't mention."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    both = F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.coalesce(assumptions, F.array().cast("array<string>")))
    return F.filter(F.array_distinct(both), lambda k: ~low.contains(F.lower(k)))


def completeness(strategies: DataFrame) -> DataFrame:
    """strategies with 0..5 by filled parts, and the parts still missing in order."""
    parts = ["features", "model", "trade_plan", "decisions", "outcomes"]
    filled = {p: F.coalesce(F.size(p) > 0, F.lit(False)) if dict(strategies.dtypes)[p].startswith("array") else F.col(p).isNotNull() for p in parts}
    return strategies.withColumns({"completeness": sum((c.cast("int") for c in filled.values()), F.lit(0)), "missing": F.array_compact(F.array(*[F.when(~c, F.lit(p)) for p, c in filled.items()]))})


def strategy_summary(strategies: DataFrame) -> DataFrame:
    """Active, archived, with outcome and mean Sharpe, in one row."""
    return strategies.agg(F.count_if(~F.col("archived")).alias("active"), F.count_if("archived").alias("archived"), F.count_if(F.col("sharpe").isNotNull()).alias("with_outcome"), F.avg("sharpe").alias("mean_sharpe"))


def backfill_worklist(papers: DataFrame) -> DataFrame:
    """Papers without lens tags or scores, the newest first."""
    return papers.where("trading_tags IS NULL OR size(trading_tags) = 0 OR scores IS NULL").orderBy(F.desc_nulls_last("year"), "paper_id")


def reviewed(cards: Column, question: str, now: Column) -> Column:
    """An array of flashcards with the review of one of them counted."""
    hit = lambda c: c["question"] == F.lit(question)
    return F.transform(cards, lambda c: F.struct(c["question"].alias("question"), c["answer"].alias("answer"), F.when(hit(c), now).otherwise(c["reviewed_at"]).alias("reviewed_at"), (c["reviews"] + hit(c).cast("int")).alias("reviews")))


def user_update(papers: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Tags and status from changes; important by its tags, first read set once when done."""
    important = F.array(*map(F.lit, ("important", "starred", "fav", "favorite")))
    j = papers.join(changes.select("paper_id", F.col("tags").alias("_tags"), F.col("reading_status").alias("_status")), "paper_id", "left")
    tags, status = F.coalesce("_tags", "tags"), F.coalesce("_status", "reading_status")
    return j.withColumns({"tags": tags, "reading_status": status}).withColumns({"is_important": F.exists("tags", lambda t: F.array_contains(important, F.lower(t))), "first_read_at": F.when((F.col("reading_status") == "done") & F.col("first_read_at").isNull(), now).otherwise(F.col("first_read_at"))}).drop("_tags", "_status")
