"""References out of text, and which of them are in the corpus."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def reference_entries(texts: DataFrame) -> DataFrame:
    """paper_id, ord, entry: after the last reference heading, at most 350 lines; [n] or "n. " begins an entry.

    Blanks are normalised per line, line ends are kept, so a heading is found wherever it stands alone.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.collapse)
    heading = r"(?i)^(?:[0-9]+[.]?\s*)?(?:bibliography|literature cited|references)\s*:?$"
    at = F.array_max(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.when(F.element_at("lines", i).rlike(heading), i)))
    cut = texts.select("paper_id", lines.alias("lines")).withColumn("at", at).where("at IS NOT NULL").select("paper_id", F.posexplode(F.slice("lines", F.col("at") + 1, 350)).alias("i", "line")).where("line <> ''")
    starts = F.col("line").rlike(r"^(?:\[[0-9]+\]|[0-9]+[.]\s)").cast("int")
    w = Window.partitionBy("paper_id").orderBy("i")
    numbered = cut.withColumn("ord", F.sum(starts).over(w))
    return numbered.groupBy("paper_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), " ").alias("entry"))


def reference_fields(entries: DataFrame) -> DataFrame:
    """doi, url, arxiv, year and a guess of the title of each entry."""
    e = F.col("entry")
    blank = lambda c: F.nullif(c, F.lit(""))
    longest = lambda a: F.try_element_at(F.array_sort(a, lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0)), F.lit(1))
    quoted = F.regexp_extract_all(e, F.lit('["“]([^"”]{6,})["”]'), 1)
    parts = F.filter(F.transform(F.slice(F.split(e, r"\.\s+"), 2, 3), lambda s: F.trim(s)), lambda s: F.length(s) >= 12)
    return entries.select("*", blank(F.regexp_extract(e, T.DOI, 0)).alias("doi"), blank(F.regexp_extract(e, T.URL, 0)).alias("url"), blank(F.regexp_extract(e, T.ARXIV, 0)).alias("arxiv"), blank(F.regexp_extract(e, T.YEAR, 0)).cast("int").alias("year_guess"), F.coalesce(longest(quoted), longest(parts)).alias("title_guess"))


def match_references(refs: DataFrame, papers: DataFrame, shared: int = 3, least: float = 0.62) -> DataFrame:
    """src, dst, weight: refs (src, title_guess, year_guess) against papers (paper_id, title, year).

    An inverted index: equal tokens are joined and counted, Jaccard follows from the counts. The best
    paper of each reference, years at most 1 apart where both are known, each pair once.
    """
    r = refs.select(F.monotonically_increasing_id().alias("ref"), "src", F.col("year_guess").alias("ry"), T.token_set(F.col("title_guess")).alias("rt"))
    p = papers.select(F.col("paper_id").alias("dst"), F.col("year").alias("py"), T.token_set(F.col("title")).alias("pt"))
    left = r.select("ref", "src", "ry", F.size("rt").alias("rn"), F.explode("rt").alias("token"))
    right = p.select("dst", "py", F.size("pt").alias("pn"), F.explode("pt").alias("token"))
    near = F.coalesce(F.abs(F.col("ry") - F.col("py")) <= 1, F.lit(True))
    hits = left.join(right, "token").groupBy("ref", "src", "dst", "rn", "pn", "ry", "py").agg(F.count("*").alias("s")).where(F.col("s") >= shared)
    scored = hits.withColumn("score", F.col("s") / (F.col("rn") + F.col("pn") - F.col("s"))).where((F.col("score") >= least) & near)
    w = Window.partitionBy("ref").orderBy(F.desc("score"), "dst")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.groupBy("src", "dst").agg(F.max("score").alias("weight"))
