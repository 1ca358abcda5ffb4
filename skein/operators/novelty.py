"""Novelty, saturation, z-scores and drift contributions of papers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import topics


def centroid_mean(papers: DataFrame) -> DataFrame:
    return V.mean_vectors(papers.where("cluster_id IS NOT NULL"), ["cluster_id"])


def centroid_unit(papers: DataFrame) -> DataFrame:
    return centroid_mean(papers).select("cluster_id", V.unit(F.col("centroid")).alias("centroid"))


def global_mean(papers: DataFrame) -> DataFrame:
    return V.mean_vectors(papers.withColumn("_all", F.lit(1)), ["_all"]).select(F.col("centroid").alias("global_mean"))


def novelty(papers: DataFrame) -> DataFrame:
    """Distances to the unit centroid of the cluster and to the global mean, and the cosine with the
    cluster's drift into the next year; a missing year or drift gives direction 0."""
    p = papers.join(centroid_unit(papers), "cluster_id", "left").crossJoin(F.broadcast(global_mean(papers)))
    p = p.join(topics.drift_vectors(papers).select("cluster_id", "year", "drift_vector"), ["cluster_id", "year"], "left")
    p = p.join(V.mean_vectors(papers.where("cluster_id IS NOT NULL"), ["cluster_id"], out="raw_mean"), "cluster_id", "left")
    direction = V.cosine(V.subtract(F.col("embedding"), F.col("raw_mean")), F.col("drift_vector"))
    return p.select("paper_id", F.coalesce(V.distance(F.col("embedding"), F.col("centroid")), F.lit(0.0)).alias("cluster_novelty"), V.distance(F.col("embedding"), F.col("global_mean")).alias("global_novelty"), F.coalesce(direction, F.lit(0.0)).alias("directional_novelty"))


def drift_contribution(papers: DataFrame, influence: DataFrame | None = None) -> DataFrame:
    """cos(vector - mean of its cluster and year, drift) * |drift| * influence (1 if unknown)."""
    base = papers.join(topics.yearly_centroids(papers), ["cluster_id", "year"]).join(topics.drift_vectors(papers), ["cluster_id", "year"])
    if influence is None:
        base = base.withColumn("influence", F.lit(1.0))
    else:
        base = base.join(influence.select("paper_id", "influence"), "paper_id", "left").withColumn("influence", F.coalesce("influence", F.lit(1.0)))
    c = V.cosine(V.subtract(F.col("embedding"), F.col("centroid")), F.col("drift_vector"))
    return base.select("paper_id", (c * V.norm(F.col("drift_vector")) * F.col("influence")).alias("contribution"))


def z_scores(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """z over all rows, or within each value of `by` (0 where that is null); a deviation below 1e-6 counts as 1.

    Group statistics are joined back, so no group is sorted in one task.
    """
    x = F.col(column)
    stats = [F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s")]
    if by is None:
        joined = values.crossJoin(F.broadcast(values.agg(*stats)))
    else:
        joined = values.join(values.where(F.col(by).isNotNull()).groupBy(by).agg(*stats), by, "left")
    z = (x - F.col("_m")) / F.when(F.col("_s") <= 1e-6, F.lit(1.0)).otherwise(F.col("_s"))
    return joined.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def novelty_saturation(papers: DataFrame, neighbours: DataFrame, k: int = 3) -> DataFrame:
    """novelty 1 - (cos + 1) / 2 to the cluster's mean; saturation the mean of the k best same-cluster cosines in 0..1.

    neighbours: src, dst, score of pairs within a cluster.
    """
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    best = neighbours.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    near = best.groupBy(F.col("src").alias("paper_id")).agg(F.avg((F.col("score") + 1) / 2).alias("saturation"), F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda s: s["dst"]).alias("nearest"))
    base = papers.join(centroid_mean(papers), "cluster_id").select("paper_id", (1 - (V.cosine(F.col("embedding"), F.col("centroid")) + 1) / 2).alias("novelty"))
    return base.join(near, "paper_id", "left").select("paper_id", "novelty", F.coalesce("saturation", F.lit(0.0)).alias("saturation"), "nearest")


def combinational_novelty(tags: DataFrame) -> DataFrame:
    """tags: paper_id, tags (array). -ln of how much likelier the paper's tag pairs are than chance, with
    Laplace-smoothed shares; a single tag counts by its own share, none gives 0."""
    each = tags.select("paper_id", F.explode_outer(F.array_distinct("tags")).alias("tag"))
    n = tags.agg(F.countDistinct("paper_id").alias("papers"))
    share = each.where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("f")).crossJoin(F.broadcast(n)).select("tag", ((F.col("f") + 1) / (F.col("papers") + 2)).alias("p"))
    own = each.where("tag IS NOT NULL")
    pairs = own.select("paper_id", F.col("tag").alias("a")).join(own.select("paper_id", F.col("tag").alias("b")), "paper_id").where("a < b")
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("f")).crossJoin(F.broadcast(n)).select("a", "b", ((F.col("f") + 1) / (F.col("papers") + 2)).alias("pp"))
    together = pairs.join(joint, ["a", "b"]).groupBy("paper_id").agg(F.avg("pp").alias("pair_mean"))
    alone = own.join(share, "tag").groupBy("paper_id").agg(F.exp(F.sum(F.ln("p"))).alias("product"), F.count("*").alias("k"))
    scored = each.select("paper_id").distinct().join(alone, "paper_id", "left").join(together, "paper_id", "left")
    value = F.when(F.col("k").isNull(), 0.0).otherwise(-F.ln((F.coalesce("pair_mean", "product") + 1e-9) / (F.col("product") + 1e-9)))
    return scored.select("paper_id", value.alias("combinational_novelty"))
