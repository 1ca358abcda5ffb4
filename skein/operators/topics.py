"""Counts, drift, bursts and phases of clusters over years."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vector as V


def topic_trends(papers: DataFrame) -> DataFrame:
    return papers.where("cluster_id IS NOT NULL AND year IS NOT NULL").groupBy("cluster_id", "year").agg(F.count("*").alias("n"))


def yearly_centroids(papers: DataFrame) -> DataFrame:
    return V.mean_vectors(papers.where("cluster_id IS NOT NULL AND year IS NOT NULL"), ["cluster_id", "year"])


def drift(papers: DataFrame) -> DataFrame:
    """How far each cluster's mean moved since the year before it; first years 0, single years left out."""
    w = Window.partitionBy("cluster_id").orderBy("year")
    every = Window.partitionBy("cluster_id")
    step = yearly_centroids(papers).select("*", F.lag("centroid").over(w).alias("before"), F.lag("year").over(w).alias("from_year"), F.count("*").over(every).alias("years"))
    delta = F.when(F.col("before").isNotNull(), V.subtract(F.col("centroid"), F.col("before")))
    moved = step.where("years >= 2").withColumn("delta", delta).withColumn("drift", F.coalesce(V.norm(F.col("delta")), F.lit(0.0)))
    part = lambda i: F.when(F.col("drift") > 0, F.try_element_at("delta", F.lit(i)) / F.nullif(F.col("drift"), F.lit(0.0)))
    return moved.select("cluster_id", "year", "from_year", "drift", F.coalesce(part(1), F.lit(0.0)).alias("dx"), F.coalesce(part(2), F.lit(0.0)).alias("dy"))


def drift_vectors(papers: DataFrame) -> DataFrame:
    """The vector from each year's mean to the next year's."""
    w = Window.partitionBy("cluster_id").orderBy("year")
    step = yearly_centroids(papers).select("cluster_id", "year", "centroid", F.lead("centroid").over(w).alias("after"), F.lead("year").over(w).alias("to_year"))
    return step.where("after IS NOT NULL").select("cluster_id", "year", "to_year", V.subtract(F.col("after"), F.col("centroid")).alias("drift_vector"))


def drift_volatility(drifts: DataFrame) -> DataFrame:
    return drifts.groupBy("cluster_id").agg(F.stddev_pop("drift").alias("volatility"), F.avg("drift").alias("mean_drift"))


def latest_drift(drifts: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("year", "drift", "dx", "dy"), "year")
    return drifts.groupBy("cluster_id").agg(last.alias("s")).select("cluster_id", "s.*")


def top_drift(drifts: DataFrame, limit: int = 5) -> DataFrame:
    return drifts.orderBy(F.desc("drift"), "cluster_id", "year").limit(limit)


def yearly_series(papers: DataFrame, own_axis: bool = False) -> DataFrame:
    """Counts per cluster on a year axis filled with zeros: all clusters' years, or each one's own."""
    counts = topic_trends(papers)
    if own_axis:
        axis = counts.groupBy("cluster_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    else:
        span = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
        axis = counts.select("cluster_id").distinct().crossJoin(F.broadcast(span)).select("cluster_id", F.explode(F.sequence("lo", "hi")).alias("year"))
    return axis.join(counts, ["cluster_id", "year"], "left").select("cluster_id", "year", F.coalesce("n", F.lit(0)).alias("n"))


def burst_scores(series: DataFrame, window: int = 4) -> DataFrame:
    """z of each point in its trailing window (the point included), sample deviation; 0 where undefined."""
    w = Window.partitionBy("cluster_id").orderBy("year").rowsBetween(1 - window, 0)
    sd = F.stddev_samp("n").over(w)
    z = (F.col("n") - F.avg("n").over(w)) / F.nullif(sd, F.lit(0.0))
    return series.withColumn("z", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)))


def changepoints(series: DataFrame, threshold: float = 1.75, min_gap: int = 2, min_years: int = 4) -> DataFrame:
    """Years where |z| reaches the threshold or growth turns, at least min_gap years apart.

    The gap is a fold along the years, done inside one array per cluster.
    """
    w = Window.partitionBy("cluster_id").orderBy("year")
    scored = burst_scores(series).withColumn("growth", F.col("n") - F.lag("n").over(w)).withColumn("before", F.lag("growth").over(w)).withColumn("i", F.row_number().over(w) - 1)
    turn = (F.signum("growth") != F.signum("before")) & (F.col("growth") != 0) & (F.col("before") != 0)
    hit = (F.col("i") >= 2) & ((F.abs("z") >= threshold) | F.coalesce(turn, F.lit(False)))
    years = scored.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.when(hit, F.col("year")))).alias("years"), F.count("*").alias("size")).where(F.col("size") >= min_years)
    keep = lambda kept, y: F.when((F.size(kept) == 0) | (y - F.try_element_at(kept, F.lit(-1)) >= min_gap), F.concat(kept, F.array(y))).otherwise(kept)
    return years.select("cluster_id", F.explode(F.aggregate("years", F.array().cast("array<int>"), keep)).alias("year"))


def phases(series: DataFrame) -> DataFrame:
    """emerging, accelerating, fading, mature or unknown, from the last three years against those before."""
    all_of = series.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "n"))), lambda s: s["n"].cast("double")).alias("c"))
    n = F.size("c")
    last = F.slice("c", F.greatest(n - 2, F.lit(1)), 3)
    rest = F.slice("c", 1, F.greatest(n - 3, F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    slope = (F.element_at("c", -1) - F.element_at("c", -3)) / 2
    baseline = F.coalesce(total(rest) / F.nullif(F.size(rest), F.lit(0)), F.lit(0.0))
    recent = total(last) / 3
    phase = (F.when(n < 3, "unknown").when((baseline < 1) & (recent >= 1) & (slope >= 0), "emerging").when(slope > 0.75, "accelerating").when(slope < -0.75, "fading").when(recent > 0, "mature").otherwise("unknown"))
    return all_of.select("cluster_id", F.when(n >= 3, slope).alias("slope"), F.when(n >= 3, baseline).alias("baseline"), phase.alias("phase"))


def lifecycle(papers: DataFrame, burst: float = 2.0) -> DataFrame:
    """Per cluster on the common year axis: total, peak year, bursts and phase."""
    scored = burst_scores(yearly_series(papers))
    stats = scored.groupBy("cluster_id").agg(F.sum("n").alias("total"), F.min_by("year", F.struct(-F.col("n"), F.col("year"))).alias("peak_year"), F.count_if(F.col("z") >= burst).alias("bursts"), F.max("z").alias("max_z"))
    return stats.join(phases(scored.select("cluster_id", "year", "n")), "cluster_id")


def weighted_lifecycle(papers: DataFrame, centrality: DataFrame) -> DataFrame:
    """Per cluster the latest year's count and burst score, of the counts and of the sums of centrality (1 if unknown)."""
    weight = papers.join(centrality.select("paper_id", "centrality"), "paper_id", "left").where("year IS NOT NULL AND cluster_id IS NOT NULL").groupBy("cluster_id", "year").agg(F.sum(F.coalesce("centrality", F.lit(1.0))).alias("w"))
    series = yearly_series(papers)
    plain = burst_scores(series)
    heavy = burst_scores(series.join(weight, ["cluster_id", "year"], "left").select("cluster_id", "year", F.coalesce("w", F.lit(0.0)).alias("n")))
    last = lambda d, *names: d.groupBy("cluster_id").agg(*[F.max_by(c, "year").alias(n) for c, n in names])
    return last(plain, ("year", "latest_year"), ("n", "latest_count"), ("z", "latest_z")).join(last(heavy, ("n", "latest_weight"), ("z", "latest_weighted_z")), "cluster_id").join(phases(series).select("cluster_id", "phase"), "cluster_id")


def topic_evolution(papers: DataFrame) -> DataFrame:
    """Bursts (from 0 to 2 or more, or doubled) and decays (to half or less) on each cluster's own axis."""
    w = Window.partitionBy("cluster_id").orderBy("year")
    s = yearly_series(papers, own_axis=True).withColumn("before", F.lag("n").over(w))
    burst = F.when(F.col("before") == 0, F.col("n") >= 2).otherwise(F.col("n") >= 2 * F.col("before"))
    decay = (F.col("before") > 0) & (F.col("n") <= F.floor(F.col("before") / 2))
    return s.select("cluster_id", "year", "n", F.coalesce(burst, F.lit(False)).alias("burst"), F.coalesce(decay, F.lit(False)).alias("decay"))


def method_mentions(texts: DataFrame, tags: list[str], columns: list[str]) -> DataFrame:
    """(tag, year, n): texts of each year that contain the tag."""
    low = F.lower(F.concat_ws(" ", *columns))
    found = F.filter(F.array(*[F.lit(t) for t in tags]), lambda t: low.contains(F.lower(t)))
    return texts.where("year IS NOT NULL").select("year", F.explode(found).alias("tag")).groupBy("tag", "year").agg(F.count("*").alias("n"))


def method_takeovers(mentions: DataFrame) -> DataFrame:
    """For each pair of tags the first year in which the one behind in cumulative counts leads."""
    span = mentions.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    names = mentions.select("tag").distinct()
    axis = names.crossJoin(F.broadcast(span)).select("tag", F.explode(F.sequence("lo", "hi")).alias("year"))
    w = Window.partitionBy("tag").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    total = axis.join(mentions, ["tag", "year"], "left").select("tag", "year", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("total"))
    pair = total.select(F.col("tag").alias("a"), "year", F.col("total").alias("ta")).join(total.select(F.col("tag").alias("b"), "year", F.col("total").alias("tb")), "year").where("a < b")
    by_year = Window.partitionBy("a", "b").orderBy("year")
    signs = pair.withColumn("sign", F.signum(F.col("ta") - F.col("tb"))).where("sign <> 0").withColumn("before", F.lag("sign").over(by_year))
    crossing = signs.where("sign <> before").groupBy("a", "b").agg(F.min_by(F.struct("year", "sign"), "year").alias("s"))
    return crossing.select("a", "b", F.col("s.year").alias("crossing_year"), F.when(F.col("s.sign") > 0, F.col("a")).otherwise(F.col("b")).alias("leader"))


def reading_lag(reads: DataFrame) -> DataFrame:
    """reads: cluster_id, pub_year, read_year. Mean and median lag; at most 1 year is real-time, 2 and more late."""
    lag = reads.where("pub_year IS NOT NULL AND read_year IS NOT NULL").withColumn("lag", F.col("read_year") - F.col("pub_year"))
    by = lag.groupBy("cluster_id").agg(F.avg("lag").alias("mean_lag"), F.median("lag").alias("median_lag"), F.count("*").alias("n"))
    return by.withColumn("kind", F.when(F.col("median_lag") <= 1, "real-time").when(F.col("median_lag") >= 2, "late").otherwise("between"))


def year_histogram(papers: DataFrame, last_year: int) -> DataFrame:
    """Papers per year with zeros between; years outside 1900..last_year don't count."""
    good = papers.where(F.col("year").between(1900, last_year)).groupBy("year").agg(F.count("*").alias("n"))
    axis = good.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return axis.join(good, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def counterfactuals(papers: DataFrame, degrees: DataFrame, cutoffs=(2010, 2015, 2020)) -> DataFrame:
    """For each cutoff the papers of that year or later and their mean degree; a missing year is 0."""
    joined = papers.select("paper_id", F.coalesce("year", F.lit(0)).alias("year")).join(degrees, "paper_id", "left")
    kept = joined.select("*", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")).withColumn("inside", F.col("year") >= F.col("cutoff"))
    return kept.groupBy("cutoff").agg(F.count_if("inside").alias("n"), F.coalesce(F.avg(F.when(F.col("inside"), F.col("degree"))), F.lit(0.0)).alias("mean_degree"))


def mean_year(papers: DataFrame) -> DataFrame:
    return papers.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.avg("year").alias("mean_year"))


def factor_exposure(loadings: DataFrame, key: str = "year") -> DataFrame:
    """loadings: a key and an array; the mean loading of each factor by key."""
    return loadings.where(F.col(key).isNotNull()).select(key, F.posexplode("loadings").alias("factor", "x")).groupBy(key, "factor").agg(F.avg("x").alias("exposure"))


def read_years(papers: DataFrame, log: DataFrame) -> DataFrame:
    """paper_id, read_year: the first logged event's year, else the publication year."""
    first = log.groupBy("paper_id").agg(F.year(F.min("ts")).alias("event_year"))
    return papers.join(first, "paper_id", "left").select("paper_id", F.coalesce("event_year", "year").alias("read_year"))


def strongest_factors(loadings: DataFrame, limit: int = 3) -> DataFrame:
    each = loadings.select("paper_id", F.posexplode("loadings").alias("factor", "x"))
    w = Window.partitionBy("paper_id").orderBy(F.desc(F.abs("x")), "factor")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
