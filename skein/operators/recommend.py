"""Reading coverage, blind spots, recommendations, retrieval, filters and orders."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import claims


def read_scores(log: DataFrame) -> DataFrame:
    """paper_id, opens, notes, last_open, read_score = 1 - exp(-(.55 opens + .9 notes))."""
    c = log.groupBy("paper_id").agg(F.count_if(F.col("event_type") == "opened").alias("opens"), F.count_if(F.col("event_type") == "note_saved").alias("notes"), F.max(F.when(F.col("event_type") == "opened", F.col("ts"))).alias("last_open"))
    return c.withColumn("read_score", F.least(F.lit(1.0), 1 - F.exp(-(0.55 * F.col("opens") + 0.9 * F.col("notes")))))


def coverage(papers: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean read score of each cluster; an unread paper counts 0."""
    return papers.join(scores.select("paper_id", "read_score"), "paper_id", "left").where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.avg(F.coalesce("read_score", F.lit(0.0))).alias("coverage"))


def interest(papers: DataFrame, scores: DataFrame, as_of: str, half: float = 60.0) -> DataFrame:
    """The mean vector of the opened papers, each weighted by exp(-age in days / half) at its last opening."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_open")) / 86400.0
    opened = papers.join(scores.where("opens > 0"), "paper_id").withColumn("_w", F.exp(-F.greatest(age, F.lit(0.0)) / half)).withColumn("_all", F.lit(1))
    return V.mean_vectors(opened, ["_all"], weight=F.col("_w"), out="interest").select("interest")


def blind_spots(centroids: DataFrame, covered: DataFrame, profile: DataFrame, top: int = 18) -> DataFrame:
    """Clusters near the interest and little read: max(0, cos) * (1 - coverage)."""
    c = centroids.join(covered, "cluster_id").crossJoin(F.broadcast(profile))
    s = F.greatest(F.lit(0.0), V.cosine(F.col("centroid"), F.col("interest"))) * (1 - F.col("coverage"))
    return c.select("cluster_id", "coverage", s.alias("blindspot")).orderBy(F.desc("blindspot"), "cluster_id").limit(top)


def question_gaps(log: DataFrame, docs: DataFrame | None = None, limit: int | None = 80, top: int = 6) -> DataFrame:
    """question, asked, answered, top_score, margin, breadth; unanswered first, then the most asked, then the weakest.

    log: event_type, q and, where retrievals are logged, seq, top_scores, support_breadth; the last
    retrieval of a question counts. Without one, docs (id, text, cluster_id) are searched by their
    term weights: the `top` best cosines, and the entropy of their clusters as breadth. A document
    that shares no term scores 0 and adds no cluster.
    """
    base = log.withColumn("question", F.trim("q")).where("question <> ''")
    n = base.groupBy("question").agg(F.count_if(F.col("event_type") == "qa_question").alias("asked"), F.count_if(F.col("event_type") == "qa_answer_ready").alias("answered"))
    none = F.lit(None).cast("double")
    if "top_scores" in log.columns:
        got = base.where("event_type = 'qa_retrieval'").groupBy("question").agg(F.max_by(F.struct("top_scores", "support_breadth"), "seq").alias("r"))
        scores = F.slice(F.array_compact(F.coalesce("r.top_scores", F.array().cast("array<double>"))), 1, top)
        logged = got.select("question", scores.alias("s"), F.coalesce("r.support_breadth", F.lit(0.0)).alias("breadth"))
    else:
        logged = n.select("question", F.array().cast("array<double>").alias("s"), none.alias("breadth")).where(F.lit(False))
    if docs is not None:
        rest = n.select("question").join(logged, "question", "left_anti")
        logged = logged.unionByName(_searched(rest, docs, top))
    at = lambda i: F.coalesce(F.try_element_at("s", F.lit(i)), F.lit(0.0))
    each = n.join(logged, "question", "left").select("question", "asked", "answered", at(1).alias("top_score"), (at(1) - at(2)).alias("margin"), F.coalesce("breadth", F.lit(0.0)).alias("breadth"))
    ordered = each.orderBy(F.col("answered") > 0, F.desc("asked"), "top_score", "question")
    return ordered if limit is None else ordered.limit(limit)


def _searched(questions: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """question, s (best cosines), breadth from the term weights of docs."""
    weights, model = claims.tfidf_model(docs, "id", "text")
    q = claims.weighted(claims.terms(questions.withColumn("text", F.col("question")), "question", "text").groupBy("question", "term").agg(F.count("*").alias("tf")), model, "question")
    hits = q.join(weights.select("id", "term", F.col("weight").alias("w")), "term").groupBy("question", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    best = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).join(docs.select("id", "cluster_id"), "id")
    scores = best.groupBy("question").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    share = best.where("cluster_id IS NOT NULL").groupBy("question", "cluster_id").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    total = share.groupBy("question").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    breadth = share.join(total, "question").where("total > 1").groupBy("question").agg((F.sum(-p * F.ln(p + 1e-12)) / F.ln(F.greatest(F.lit(2), F.first("k")))).alias("breadth"))
    return questions.join(scores, "question", "left").join(breadth, "question", "left").select("question", F.coalesce("s", F.array().cast("array<double>")).alias("s"), F.coalesce("breadth", F.lit(0.0)).alias("breadth"))


def simple_recommendations(loadings: DataFrame, novelty: DataFrame, degree: DataFrame, top: int = 10) -> DataFrame:
    """.6 * sum |first three loadings| + .3 novelty + .1 degree."""
    three = F.aggregate(F.transform(F.slice("loadings", 1, 3), lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x)
    j = loadings.select("paper_id", three.alias("l")).join(novelty, "paper_id", "left").join(degree.select("paper_id", "degree"), "paper_id", "left")
    return j.select("paper_id", (0.6 * F.col("l") + 0.3 * F.coalesce("cluster_novelty", F.lit(0.0)) + 0.1 * F.coalesce("degree", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "paper_id").limit(top)


def marginal_gain(centroids: DataFrame, covered: DataFrame, papers: DataFrame, scores: DataFrame, picks: int = 8, candidates: int = 1_200) -> DataFrame:
    """Greedy facility location: papers that add most similarity to little-covered clusters.

    The candidate limit is the operator's own parameter; gains are computed on candidates x clusters.
    """
    spark = papers.sparkSession
    c = centroids.join(covered, "cluster_id").orderBy("cluster_id").collect()  # one row for each cluster
    read = papers.join(scores.select("paper_id", "read_score"), "paper_id", "left").select("paper_id", "embedding", F.coalesce("read_score", F.lit(0.0)).alias("r"))
    schema = "paper_id long, gain double, pick int"
    if not c:
        return spark.createDataFrame([], schema)
    w = np.array([1 - r["coverage"] for r in c])
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    centre = unit(np.array([r["centroid"] for r in c], float))
    known, matrix = spark.sparkContext.broadcast((centre, w)), None

    def weigh(batches):
        centre, w = known.value
        for b in batches:
            s = np.maximum(0, unit(np.array(b["embedding"].tolist(), float).reshape(-1, centre.shape[1])) @ centre.T)
            yield b[["paper_id", "r"]].assign(total=s @ w, sims=list(s))

    weighed = read.mapInPandas(weigh, "paper_id long, r double, total double, sims array<double>")
    best_read = weighed.where("r >= 0.5").select(F.posexplode("sims").alias("i", "s")).groupBy("i").agg(F.max("s").alias("s")).collect()
    best = np.zeros(len(c))
    for r in best_read:
        best[r["i"]] = r["s"]
    pool = weighed.where("r < 0.15").orderBy(F.desc("total"), "paper_id").limit(candidates).collect()
    ids, matrix = [r["paper_id"] for r in pool], np.array([r["sims"] for r in pool]).reshape(-1, len(c))
    out = []
    while len(out) < picks and len(matrix):
        gain = (w * np.maximum(0, matrix - best)).sum(1)
        at = int(gain.argmax())
        if gain[at] <= 0:
            break
        out.append((ids[at], float(gain[at]), len(out) + 1))
        best = np.maximum(best, matrix[at])
    return spark.createDataFrame(out, schema)


def answer_confidence(neighbours: DataFrame) -> DataFrame:
    """Mean Jaccard of each paper's six nearest with those of its next four."""
    sets = neighbours.where("rank <= 6").groupBy("src").agg(F.collect_set("dst").alias("s"))
    near = neighbours.where("rank <= 4").select("src", "dst")
    j = near.join(sets, "src").join(sets.select(F.col("src").alias("dst"), F.col("s").alias("o")), "dst")
    return j.groupBy(F.col("src").alias("paper_id")).agg(F.avg(F.size(F.array_intersect("s", "o")) / F.size(F.array_union("s", "o"))).alias("confidence"))


def event_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def bridging_papers(papers: DataFrame, a: Column, b: Column, top: int = 10) -> DataFrame:
    """Papers close to both vectors, by the lesser cosine."""
    s = F.least(V.cosine(F.col("embedding"), a), V.cosine(F.col("embedding"), b))
    return papers.select("paper_id", s.alias("score")).orderBy(F.desc("score"), "paper_id").limit(top)


def retrieve(papers: DataFrame, chunks: DataFrame, query: list[float], k: int = 8, years: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, evidence): candidates by paper vector, chunks of those by their own, papers by best chunk, filled up to k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if years:
        papers = papers.where(F.col("year").between(*years))
    cand = papers.select("paper_id", V.cosine(F.col("embedding"), q).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "paper_id").limit(max(10 * k, 60))
    ev = chunks.join(F.broadcast(cand.select("paper_id")), "paper_id", "left_semi").select("chunk_id", "paper_id", V.cosine(F.col("embedding"), q).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "chunk_id").limit(max(12, 3 * k))
    by = ev.groupBy("paper_id").agg(F.max("score").alias("score")).withColumn("filler", F.lit(0))
    fill = cand.join(by.select("paper_id"), "paper_id", "left_anti").withColumn("filler", F.lit(1))
    return by.unionByName(fill).orderBy("filler", F.desc("score"), "paper_id").limit(k).select("paper_id", "score", (F.col("filler") == 1).alias("filler")), ev


def recommended_next(papers: DataFrame, read: DataFrame, top: int = 5) -> DataFrame:
    """Unread papers nearest the mean of the read ones."""
    profile = V.mean_vectors(papers.join(read, "paper_id", "left_semi").withColumn("_all", F.lit(1)), ["_all"], out="profile").select("profile")
    rest = papers.join(read, "paper_id", "left_anti").crossJoin(F.broadcast(profile))
    return rest.select("paper_id", V.cosine(F.col("embedding"), F.col("profile")).alias("score")).orderBy(F.desc("score"), "paper_id").limit(top)


def profile_blind_spots(papers: DataFrame, read: DataFrame, top: int = 5) -> DataFrame:
    """Unread papers nearer the corpus mean than the reader's: max(0, cos global - cos profile)."""
    mean = lambda d, out: V.mean_vectors(d.withColumn("_all", F.lit(1)), ["_all"], out=out).select(out)
    rest = papers.join(read, "paper_id", "left_anti").crossJoin(F.broadcast(mean(papers, "g"))).crossJoin(F.broadcast(mean(papers.join(read, "paper_id", "left_semi"), "p")))
    s = F.greatest(F.lit(0.0), V.cosine(F.col("embedding"), F.col("g")) - V.cosine(F.col("embedding"), F.col("p")))
    return rest.select("paper_id", s.alias("score")).orderBy(F.desc("score"), "paper_id").limit(top)


def curriculum(papers: DataFrame, read: DataFrame, target: list[float]) -> DataFrame:
    """stage, paper_id, score: 3 foundation by the profile, 2 advanced by target less profile, 5 bridges by the lesser; each paper once."""
    t = F.array(*[F.lit(float(x)) for x in target])
    profile = V.mean_vectors(papers.join(read, "paper_id", "left_semi").withColumn("_all", F.lit(1)), ["_all"], out="p").select("p")
    rest = papers.join(read, "paper_id", "left_anti").crossJoin(F.broadcast(profile)).select("paper_id", V.cosine(F.col("embedding"), F.col("p")).alias("cp"), V.cosine(F.col("embedding"), t).alias("ct"))
    pick = lambda d, stage, score, n: d.select(F.lit(stage).alias("stage"), "paper_id", score.alias("score")).orderBy(F.desc("score"), "paper_id").limit(n)
    foundation = pick(rest, "foundation", F.col("cp"), 3)
    left = rest.join(foundation.select("paper_id"), "paper_id", "left_anti")
    advanced = pick(left, "advanced", F.col("ct") - F.col("cp"), 2)
    bridge = pick(left.join(advanced.select("paper_id"), "paper_id", "left_anti"), "bridge", F.least("cp", "ct"), 5)
    return foundation.unionByName(bridge).unionByName(advanced)


def keep_where(rows: DataFrame, years: tuple[int, int] | None = None, status: str | None = None, search: str | None = None, search_columns=(), tags=None) -> DataFrame:
    """The usual filters: a missing year fails a range, a missing status is unread, search is a substring of any column."""
    if years:
        rows = rows.where(F.coalesce(F.col("year").between(*years), F.lit(False)))
    if status:
        rows = rows.where(F.coalesce("reading_status", F.lit("unread")) == status)
    if search:
        rows = rows.where(F.lower(F.concat_ws("\n", *search_columns)).contains(search.lower()))
    if tags:
        rows = rows.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    return rows


# name: keys of (expression, value where it is null, ascending)
_YEAR, _TITLE, _ANY_CASE, _UPDATED = ("year", -10_000, False), ("title", "", True), ("lower(title)", "", True), ("updated_at", None, False)
_PRIORITY = "coalesce(strategy_impact, 0) * coalesce(usability, 0) * coalesce(confidence, 0)"
ORDERS = {
    "newest": [_YEAR], "oldest": [("year", 10_000, True)], "title": [_TITLE],
    "novelty": [("novelty", 0.0, False)], "usability": [("usability", 0.0, False)], "impact": [("strategy_impact", 0.0, False)],
    "confidence": [("confidence", 0.0, False)], "priority": [("priority", 0.0, False), _YEAR],
    "lens_priority": [(_PRIORITY, 0.0, False), ("novelty", 0.0, False), _YEAR, _ANY_CASE],
    **{f"lens_{n}": [(c, 0.0, False), _YEAR, _ANY_CASE] for n, c in {"impact": "strategy_impact", "usability": "usability", "novelty": "novelty", "confidence": "confidence"}.items()},
    "lens_recency": [_YEAR, _ANY_CASE], "lens_title": [_YEAR, _ANY_CASE],  # the year comes first in both, as surveyed
    "map_recommended": [("recommended_rank", 2**31 - 1, True), _YEAR, _TITLE], "map_recency": [_YEAR, _TITLE], "map_title": [_ANY_CASE],
    "map_novelty_z": [("coalesce(z_novelty, highlight_novelty)", 0.0, False), _YEAR, _TITLE],
    "map_consensus_z": [("coalesce(z_consensus, highlight_saturation)", 0.0, False), _YEAR, _TITLE],
    **{f"map_{c}": [(c, 0.0, False), _YEAR, _TITLE] for c in ("influence_positive", "cluster_confidence", "recombination", "rigor", "openness")},
    "map_trading_priority": [(_PRIORITY, 0.0, False), _YEAR, _TITLE],
    **{f"map_trading_{n}": [(c, 0.0, False), _YEAR, _TITLE] for n, c in {"impact": "strategy_impact", "usability": "usability", "novelty": "novelty"}.items()},
    "strategy_recent": [_UPDATED], "strategy_title": [_ANY_CASE], "strategy_outcomes": [("n_outcomes", 0, False), _UPDATED], "strategy_sharpe": [("latest_sharpe", float("-inf"), False), _UPDATED],
}


def order_keys(name: str, last: str = "paper_id") -> list[Column]:
    """The sort keys of a named order with its defaults for nulls; ties go to the id."""
    value = lambda c, d: F.expr(c) if d is None else F.coalesce(F.expr(c), F.lit(d))
    return [value(c, d).asc() if up else value(c, d).desc_nulls_last() for c, d, up in ORDERS[name]] + [F.col(last).asc()]


def order_by(rows: DataFrame, name: str, last: str = "paper_id") -> DataFrame:
    return rows.orderBy(*order_keys(name, last))


def pareto(points: DataFrame) -> DataFrame:
    """Points no other beats in both novelty and consensus: a running maximum along novelty.

    Points are first cut down to the best of each of 4096 novelty bands, so the one ordered
    window is over few rows; a point under its band's or a better band's best can't stay.
    """
    lo_hi = points.agg(F.min("novelty").alias("lo"), F.max("novelty").alias("hi"))
    band = F.least(F.lit(4095), F.floor((F.col("novelty") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 4096))
    banded = points.crossJoin(F.broadcast(lo_hi)).withColumn("band", F.coalesce(band, F.lit(0)))
    w = Window.orderBy(F.desc("band"))
    best = banded.groupBy("band").agg(F.max("consensus").alias("top")).withColumn("above", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    alive = banded.join(F.broadcast(best), "band").where("above IS NULL OR consensus > above")
    run = Window.partitionBy("band").orderBy(F.desc("novelty"), F.desc("consensus"), "paper_id").rowsBetween(Window.unboundedPreceding, -1)
    return alive.withColumn("before", F.max("consensus").over(run)).where("before IS NULL OR consensus > before").select("paper_id", "novelty", "consensus")


def central_not_recommended(degree: DataFrame, recommended: DataFrame, top: int = 5) -> DataFrame:
    return degree.join(recommended.select("paper_id"), "paper_id", "left_anti").orderBy(F.desc("degree"), "paper_id").limit(top)


def representative(papers: DataFrame, degree: DataFrame) -> DataFrame:
    """The paper of greatest degree in each cluster, else the newest."""
    j = papers.where("cluster_id IS NOT NULL").join(degree, "paper_id", "left")
    return j.groupBy("cluster_id").agg(F.max_by("paper_id", F.struct(F.coalesce("degree", F.lit(-1.0)), F.coalesce("year", F.lit(-1)), -F.col("paper_id"))).alias("paper_id"))


def briefing(papers: DataFrame, limit: int = 12) -> DataFrame:
    """6 newest, 2 oldest, 4 important, each once, the first 12."""
    pick = lambda d, o, n, s: d.orderBy(*o).limit(n).select("paper_id").withColumn("s", F.lit(s))
    parts = pick(papers, [F.desc_nulls_last("year"), "paper_id"], 6, 1).unionByName(pick(papers.where("year IS NOT NULL"), ["year", "paper_id"], 2, 2)).unionByName(pick(papers.where("is_important"), [F.desc_nulls_last("year"), "paper_id"], 4, 3))
    return parts.groupBy("paper_id").agg(F.min("s").alias("section")).orderBy("section", "paper_id").limit(limit)


def latest_sharpe(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("sharpe IS NOT NULL").groupBy("strategy_id").agg(F.max_by("sharpe", "measured_at").alias("sharpe"))


def option_list(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column, in order without regard to case, "unknown" last."""
    v = rows.select(F.explode(column).alias("value")).select(F.trim("value").alias("value")).where("value <> ''").distinct()
    return v.orderBy(F.lower("value") == "unknown", F.lower("value"), "value")


def normalised(values: Column) -> Column:
    """Trimmed, blanks dropped, ["Unknown"] if nothing is left."""
    v = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(v) > 0, v).otherwise(F.array(F.lit("Unknown")))


def primary(values: Column) -> Column:
    """The first value that isn't unknown, else Unknown."""
    return F.coalesce(F.try_element_at(F.filter(normalised(values), lambda s: F.lower(s) != "unknown"), F.lit(1)), F.lit("Unknown"))


def tag_rollup(rows: DataFrame, column: str, top: int = 64) -> DataFrame:
    """value, n: distinct values of each row counted, the most frequent."""
    return rows.select(F.explode(F.array_distinct(normalised(F.col(column)))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def tag_trends(rows: DataFrame, column: str, top: int = 6) -> DataFrame:
    best = tag_rollup(rows, column, top).select("value")
    each = rows.where("year IS NOT NULL").select("year", F.explode(F.array_distinct(normalised(F.col(column)))).alias("value"))
    return each.join(F.broadcast(best), "value", "left_semi").groupBy("value", "year").agg(F.count("*").alias("n"))


def cluster_keywords(texts: DataFrame, key: str, tokens: Column, top: int = 4) -> DataFrame:
    """The most frequent words of each group and the first three of them as its name."""
    n = texts.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    ranked = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]).alias("words"))
    return ranked.select(key, F.array_join("words", ",").alias("keywords"), F.initcap(F.array_join(F.slice("words", 1, 3), " ")).alias("name"))


def knowledge_snapshot(papers: DataFrame, read: DataFrame, topic: list[float], top: int = 5) -> DataFrame:
    """kind (known or unread), rank, paper_id, score: the papers nearest a topic vector among each kind."""
    t = F.array(*[F.lit(float(x)) for x in topic])
    kind = F.when(F.col("_read").isNotNull(), "known").otherwise("unread")
    scored = papers.join(read.select("paper_id", F.lit(1).alias("_read")), "paper_id", "left").select("paper_id", kind.alias("kind"), V.cosine(F.col("embedding"), t).alias("score"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "paper_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def pinned_first(clusters: DataFrame) -> DataFrame:
    """Pinned clusters first, then by id."""
    return clusters.orderBy(F.desc(F.coalesce("pinned", F.lit(False))), "cluster_id")


def papers_of(clusters: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers of each subtopic with its parent, the newest first: clusters (cluster_id, parent_id)."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("year"), "paper_id")
    return papers.join(clusters.select("cluster_id", "parent_id"), "cluster_id").select("parent_id", "cluster_id", "paper_id", F.row_number().over(w).alias("place"))


def average_degree(degree: DataFrame, papers: DataFrame) -> DataFrame:
    """Mean degree of each cluster's papers; those without one are left out."""
    return papers.join(degree, "paper_id").groupBy("cluster_id").agg(F.avg("degree").alias("mean_degree"))
