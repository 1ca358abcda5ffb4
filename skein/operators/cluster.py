"""Clustering, its stability, layouts and how well a layout keeps neighbourhoods."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import knn, novelty
from skein.sources.storage import materialise


FEW_CENTROIDS = 4_096


def hashed_words(text) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hash_bucket(token: Column, dim: int) -> Column:
    """A bucket from the first 32 bits of the token's MD5, the same everywhere."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def from_buckets(counts: DataFrame, key: str, dim: int) -> DataFrame:
    """key, embedding of norm 1 from counts (key, b, n)."""
    m = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("m"))
    # gaps between the filled buckets become runs of zeros, so the vector is built in one pass
    filled = F.aggregate("m", F.array().cast("array<double>"), lambda v, e: F.concat(v, F.array_repeat(F.lit(0.0), e["b"] - F.size(v)), F.array(e["n"])))
    vector = V.let(filled, lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))))
    return m.select(key, V.unit(vector).alias("embedding"))


def hash_embedding(texts: DataFrame, dim: int = 256) -> DataFrame:
    """paper_id, embedding: word counts in dim buckets of a stable hash, norm 1; no words give zeros."""
    words = texts.select("paper_id", F.explode(hashed_words(F.col("text"))).alias("token"))
    counts = words.groupBy("paper_id", hash_bucket(F.col("token"), dim).alias("b")).agg(F.count("*").cast("double").alias("n"))
    none = F.array_repeat(F.lit(0.0), dim)
    return texts.select("paper_id").distinct().join(from_buckets(counts, "paper_id", dim), "paper_id", "left").select("paper_id", F.coalesce("embedding", none).alias("embedding"))


def kmeans(papers: DataFrame, k: int, seed: int = 7, rounds: int = 25, init: str = "random") -> DataFrame:
    """paper_id, cluster_id; k is held within 1..n."""
    v = papers.where("embedding IS NOT NULL").select("paper_id", array_to_vector(V.as_double(F.col("embedding"))).alias("features"))
    n = v.count()
    if n < 2 or k < 2:
        return v.select("paper_id", F.lit(0).alias("cluster_id"))
    model = KMeans(k=min(k, n), seed=seed, maxIter=rounds, initMode=init).fit(v)
    return model.transform(v).select("paper_id", F.col("prediction").alias("cluster_id"))


def galaxy(papers: DataFrame, mega: int | None = None, sub: int | None = None) -> DataFrame:
    """paper_id, mega_id, sub_id: 5 to 8 clusters, each split into 10 to 20; the two levels have keys of their own.

    Each split is a fit of its own over all papers of its cluster, run by all executors, so that
    no worker holds a cluster.
    """
    n = papers.count()
    mega = mega or max(1, min(8, max(5, round((n / 50) ** 0.5))))
    top = materialise(kmeans(papers, min(mega, max(1, n)), init="k-means||").withColumnRenamed("cluster_id", "mega_id").join(papers.select("paper_id", "embedding"), "paper_id"))

    def split(r) -> DataFrame:
        k = sub or max(1, min(20, max(10, r["count"] // 10), r["count"]))
        return kmeans(top.where(F.col("mega_id") == r["mega_id"]), k, init="k-means||").select("paper_id", F.lit(r["mega_id"]).alias("mega_id"), F.col("cluster_id").alias("sub_id"))

    megas = top.groupBy("mega_id").count().orderBy("mega_id").collect()  # at most 8 rows
    if not megas:
        return papers.sparkSession.createDataFrame([], "paper_id long, mega_id int, sub_id int")
    with ThreadPoolExecutor(len(megas)) as pool:  # the fits are jobs side by side
        return reduce(DataFrame.unionByName, pool.map(split, megas))


def subclusters(papers: DataFrame, members: DataFrame, mega_id: int, desired: int) -> DataFrame:
    """paper_id, sub_id of one cluster split on demand into at least two."""
    return kmeans(papers.join(members.where(F.col("mega_id") == mega_id).select("paper_id"), "paper_id", "left_semi"), max(2, desired)).withColumnRenamed("cluster_id", "sub_id")


def nearest_centroids(papers: DataFrame, centroids: DataFrame) -> DataFrame:
    """papers with home (least distance), d1, d2.

    Up to FEW_CENTROIDS are broadcast as one row; more are cut into blocks of so many, each paper
    keeps the two nearest of each block, and the least of these count.
    """
    blocks = max(1, -(-centroids.count() // FEW_CENTROIDS))
    block = F.pmod(F.xxhash64("cluster_id"), F.lit(blocks))
    c = centroids.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("cs")).drop("block")
    d = F.array_sort(F.transform("cs", lambda c: F.struct(V.distance(F.col("embedding"), c["centroid"]).alias("d"), c["cluster_id"].alias("id"))))
    if blocks == 1:
        placed = papers.crossJoin(F.broadcast(c)).withColumn("ds", d)
    else:
        rows = materialise(papers.withColumn("_row", F.monotonically_increasing_id()))
        near = rows.crossJoin(c).select("_row", F.slice(d, 1, 2).alias("ds")).groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("ds"))).alias("ds"))
        placed = rows.join(near, "_row")
    return placed.select(*papers.columns, F.col("ds")[0]["id"].alias("home"), F.col("ds")[0]["d"].alias("d1"), F.try_element_at("ds", F.lit(2))["d"].alias("d2"))


def jitter(papers: DataFrame, trials: int, sigma: float, seed: int) -> DataFrame:
    """Each paper `trials` times, its vector shifted by normal noise drawn from paper and trial."""

    def run(batches):
        for b in batches:
            noisy = [np.asarray(v, float) + sigma * np.random.default_rng([seed, int(t), abs(int(p))]).normal(size=len(v)) for v, t, p in zip(b["embedding"], b["trial"], b["paper_id"])]
            yield b.assign(embedding=noisy)

    each = papers.select("paper_id", "cluster_id", V.as_double(F.col("embedding")).alias("embedding"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return each.mapInPandas(run, each.schema)


def jitter_stability(papers: DataFrame, trials: int = 10, sigma: float = 0.01, seed: int = 5) -> DataFrame:
    """Votes of the nearest centroid under noise: confidence, ambiguity (entropy over ln k), margins."""
    centroids = materialise(novelty.centroid_mean(papers))
    k = centroids.count()
    base = nearest_centroids(papers.select("paper_id", "cluster_id", "embedding").where("cluster_id IS NOT NULL"), centroids)
    votes = nearest_centroids(jitter(papers.where("cluster_id IS NOT NULL"), max(1, trials - 1), sigma, seed), centroids).select("paper_id", "home").unionByName(base.select("paper_id", F.col("cluster_id").alias("home")))
    share = votes.groupBy("paper_id", "home").agg((F.count("*") / trials).alias("p"))
    stat = share.groupBy("paper_id").agg(F.max("p").alias("confidence"), (F.sum(-F.col("p") * F.ln("p")) / float(np.log(max(2, k)))).alias("ambiguity"), F.sort_array(F.collect_list("p"), False).alias("ps"))
    return stat.join(base.select("paper_id", "cluster_id", (F.col("d2") - F.col("d1")).alias("distance_margin")), "paper_id").select("paper_id", "cluster_id", "confidence", "ambiguity", (F.col("ps")[0] - F.coalesce(F.try_element_at("ps", F.lit(2)), F.lit(0.0))).alias("margin"), "distance_margin")


def assign_clusters(cost: np.ndarray) -> np.ndarray:
    """For each row a column of its own with the least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    if n > m:
        got = assign_clusters(cost.T)
        out = np.full(n, -1)
        out[got] = np.arange(m)
        return out
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def seed_stability(papers: DataFrame, runs: int = 20, rounds: int = 15) -> DataFrame:
    """paper_id, confidence: share of k-means runs, aligned to the given clusters, that agree with the label."""
    base = novelty.centroid_mean(papers).orderBy("cluster_id").collect()  # one row a cluster
    labels, c0 = [r["cluster_id"] for r in base], np.array([r["centroid"] for r in base], float)
    own = papers.where("cluster_id IS NOT NULL").select("paper_id", "cluster_id", "embedding")
    votes = None
    for seed in range(runs):
        run = kmeans(own, len(labels), seed=seed + 1, rounds=rounds).withColumnRenamed("cluster_id", "found")
        joined = own.join(run, "paper_id")
        found = V.mean_vectors(joined, ["found"]).orderBy("found").collect()
        c1 = np.array([r["centroid"] for r in found], float)
        to = assign_clusters(np.sqrt(((c1[:, None] - c0[None]) ** 2).sum(2)))
        pairs = own.sparkSession.createDataFrame([(int(r["found"]), labels[t]) for r, t in zip(found, to) if t >= 0], f"found int, aligned {dict(own.dtypes)['cluster_id']}")
        one = joined.join(F.broadcast(pairs), "found", "left").select("paper_id", (F.col("aligned") == F.col("cluster_id")).alias("same"))
        votes = one if votes is None else votes.unionByName(one)
    return votes.groupBy("paper_id").agg((F.count_if("same") / F.count("*")).alias("confidence"))


def novelty_uncertainty(papers: DataFrame, trials: int = 5, sigma: float = 0.01, seed: int = 9) -> DataFrame:
    """Population deviation of the distance to the unit centroid over the vector and its jittered copies."""
    c = novelty.centroid_unit(papers)
    own = papers.where("cluster_id IS NOT NULL").select("paper_id", "cluster_id", V.as_double(F.col("embedding")).alias("embedding"))
    both = own.unionByName(jitter(own, trials, sigma, seed).drop("trial"))
    return both.join(c, "cluster_id").groupBy("paper_id").agg(F.stddev_pop(V.distance(F.col("embedding"), F.col("centroid"))).alias("uncertainty"))


def ranks(x: np.ndarray, block: int = 256) -> np.ndarray:
    """out[i, j]: the place of j by distance from i, in blocks of rows; a row is the last of its own list."""
    n = len(x)
    size = (x * x).sum(1)
    out = np.empty((n, n), np.int32)
    for a in range(0, n, block):
        d = size[a: a + block, None] - 2 * x[a: a + block] @ x.T + size
        here = np.arange(len(d))
        d[here, a + here] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        np.put_along_axis(out[a: a + block], order, np.arange(1, n + 1, dtype=np.int32)[None], 1)
    return out


def continuity(high: np.ndarray, low: np.ndarray, k: int) -> float:
    """1 less the penalty for neighbours in `high` that `low` moved away; roles swapped it is trustworthiness."""
    n = len(high)
    if n < 3 or k < 1 or 2 * n - 3 * k - 1 <= 0:
        return 1.0
    rh, rl = ranks(high), ranks(low)
    lost = (rh <= k) & (rl > k)
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * (rl[lost] - k).sum())


def layout_quality(papers: DataFrame, k: int = 15, limit: int = 4_000, bins: int = 10) -> DataFrame:
    """One row: continuity, trustworthiness, distortion quantiles of the first two whitened axes against all.

    Ranks need all pairs, so above `limit` papers a sample by hash of the id stands for the map, as documented.
    """
    z = knn.whiten(papers).select("paper_id", "embedding").orderBy(F.xxhash64("paper_id"), "paper_id").limit(limit).toPandas()
    x = np.array(z["embedding"].tolist(), float).reshape(len(z), -1)
    n = len(x)
    k = max(1, min(k, n - 2, (n - 1) // 2))
    y = x[:, :2]
    span = np.where(np.ptp(y, axis=0) > 0, np.ptp(y, axis=0), 1) if n else 1
    y = (y - y.min(0)) / span if n else y
    near = lambda r: r <= k
    overlap = (near(ranks(x)) & near(ranks(y))).sum(1) / k if n > 2 else np.ones(n)
    q = np.quantile(1 - overlap, [0.5, 0.9, 0.95, 0.99]) if n else np.zeros(4)
    row = (n, k, continuity(x, y, k), continuity(y, x, k), *(float(v) for v in q))
    return papers.sparkSession.createDataFrame([row], "n int, k int, continuity double, trustworthiness double, p50 double, p90 double, p95 double, p99 double")


def force_layout(centroids: DataFrame, rounds: int = 200) -> DataFrame:
    """cluster_id, x, y in 0..1: repulsion .02 / d^2, attraction .01 * max(0, cos), from a circle; few clusters."""
    rows = centroids.orderBy("cluster_id").collect()
    c = np.array([r["centroid"] for r in rows], float)
    n = len(rows)
    kind = dict(centroids.dtypes)["cluster_id"]
    if not n:
        return centroids.sparkSession.createDataFrame([], f"cluster_id {kind}, x double, y double")
    u = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    pull = 0.01 * np.maximum(0, u @ u.T)
    np.fill_diagonal(pull, 0)
    a = 2 * np.pi * np.arange(n) / n
    p = np.column_stack([np.cos(a), np.sin(a)])
    for _ in range(rounds):
        d = p[None] - p[:, None]
        r2 = np.maximum((d**2).sum(2), 1e-4)
        push = 0.02 / r2
        np.fill_diagonal(push, 0)
        size = np.sqrt(r2)[:, :, None]
        p = np.clip(p + 0.5 * ((pull[:, :, None] * d) - push[:, :, None] * d / size).sum(1), -2, 2)
    lo, hi = p.min(0), p.max(0)
    p = np.where(hi > lo, (p - lo) / np.where(hi > lo, hi - lo, 1), 0.5)
    return centroids.sparkSession.createDataFrame([(r["cluster_id"], float(x), float(y)) for r, (x, y) in zip(rows, p)], f"cluster_id {kind}, x double, y double")


def _around(clusters: DataFrame, radius, squeeze: float = 1.0) -> DataFrame:
    """cluster_id, x, y at a radius from the middle; the angle is the cluster's place in the order of ids."""
    w = Window.orderBy("cluster_id")  # one row a cluster
    turn = 2 * np.pi * (F.row_number().over(w) - 1) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy()))
    return clusters.withColumn("turn", turn).select("cluster_id", (0.5 + squeeze * radius * F.cos("turn")).alias("x"), (0.5 + squeeze * radius * F.sin("turn")).alias("y"))


def lens_positions(clusters: DataFrame, profile: list[float]) -> DataFrame:
    """Interest lens: the radius .25 to .85 falls with the cosine of the centroid to a profile; another dimension counts as cosine 0."""
    q = F.array(*[F.lit(float(x)) for x in profile])
    similar = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(V.cosine(F.col("centroid"), q), F.lit(0.0))))
    return _around(clusters, 0.25 + 0.6 * (1 - (similar + 1) / 2))


def time_lens(papers: DataFrame) -> DataFrame:
    """Time lens: the radius .25 to .8 falls with the mean year of a cluster's papers; without years it is the earliest."""
    mean = papers.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.avg("year").alias("mean_year"))
    span = mean.agg(F.min("mean_year").alias("lo"), F.max("mean_year").alias("hi"))
    placed = mean.crossJoin(F.broadcast(span))
    lo = F.coalesce("lo", F.lit(0.0))
    radius = 0.25 + 0.55 * (1 - (F.coalesce("mean_year", lo) - lo) / F.greatest(F.lit(1.0), F.coalesce("hi", F.lit(0.0)) - lo))
    return _around(placed, radius, 0.9)


def text_lens(papers: DataFrame, text: str, fallback: DataFrame, dim: int = 256) -> DataFrame:
    """Method and data lenses: force layout of the hashed words of all of a cluster's texts; fallback (cluster_id, text) where it has none."""
    words = papers.where(F.col("cluster_id").isNotNull()).select("cluster_id", F.explode(hashed_words(F.col(text))).alias("token"))
    have = words.select("cluster_id").distinct()
    rest = fallback.join(have, "cluster_id", "left_anti").select("cluster_id", F.explode(hashed_words(F.col("text"))).alias("token"))
    counts = words.unionByName(rest).groupBy("cluster_id", hash_bucket(F.col("token"), dim).alias("b")).agg(F.count("*").cast("double").alias("n"))
    return force_layout(from_buckets(counts, "cluster_id", dim).withColumnRenamed("embedding", "centroid"))


def layout_grid(papers: DataFrame, distortion: DataFrame, bins: int = 10, top: int = 120) -> DataFrame:
    """x_bin, y_bin, n, mean distortion of a bins x bins grid over positions (paper_id, x, y), the worst cells first."""
    span = papers.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, a, b: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.coalesce(F.floor((F.col(v) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)) * bins), F.lit(0)))).cast("int")
    placed = papers.crossJoin(F.broadcast(span)).select("paper_id", cell("x", "x0", "x1").alias("x_bin"), cell("y", "y0", "y1").alias("y_bin"))
    return placed.join(distortion, "paper_id").groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), F.avg("distortion").alias("mean_distortion")).orderBy(F.desc("mean_distortion"), F.desc("n"), "x_bin", "y_bin").limit(top)


def insights(papers: DataFrame, key: str, newest: int = 3) -> DataFrame:
    """The newest titles of each group, in order."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("year"), "paper_id")
    ranked = papers.withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    return ranked.select(key, "r", "paper_id", "title")


def factor_labels(weights: DataFrame, factors: int = 8, top: int = 4, rounds: int = 200, terms: int = 600, seed: int = 3) -> DataFrame:
    """factor, rank, term: the strongest terms of a non-negative factorisation of (paper_id, term, weight).

    Only the terms x terms products reach the driver: the `terms` most used terms, their Gram matrix
    summed in Spark; the factors of the Gram matrix by symmetric multiplicative updates.
    """
    spark = weights.sparkSession
    names = [r["term"] for r in weights.groupBy("term").agg(F.sum("weight").alias("s")).orderBy(F.desc("s"), "term").limit(terms).collect()]
    if not names:
        return spark.createDataFrame([], "factor int, rank int, term string")
    place = spark.createDataFrame(list(enumerate(names)), "i int, term string")
    w = weights.join(place, "term").select("paper_id", "i", "weight")
    pairs = w.alias("a").join(w.alias("b"), "paper_id").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("g")).collect()
    g = np.zeros((len(names), len(names)))
    for r in pairs:
        g[r["i"], r["j"]] = r["g"]
    h = np.random.default_rng(seed).random((len(names), min(factors, len(names)))) + 0.1
    for _ in range(rounds):
        h *= 0.5 + 0.5 * (g @ h) / np.maximum(h @ (h.T @ h), 1e-12)
    out = [(k, r + 1, names[i]) for k in range(h.shape[1]) for r, i in enumerate(np.argsort(-h[:, k], kind="stable")[:top])]
    return spark.createDataFrame(out, "factor int, rank int, term string")


def neighbour_overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """id, overlap, distortion of clusters: shared k nearest between two spaces (cluster_id, centroid) by distance."""

    def near(space: DataFrame) -> DataFrame:
        a, b = space.alias("a"), space.alias("b")
        d = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id")).select(F.col("a.cluster_id").alias("cluster_id"), F.col("b.cluster_id").alias("other"), V.distance(F.col("a.centroid"), F.col("b.centroid")).alias("d"))
        w = Window.partitionBy("cluster_id").orderBy("d", "other")
        return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("cluster_id").agg(F.collect_set("other").alias("near"))

    both = near(high).join(near(low).withColumnRenamed("near", "there"), "cluster_id")
    return both.select("cluster_id", (F.size(F.array_intersect("near", "there")) / F.lit(k)).alias("overlap")).withColumn("distortion", 1 - F.col("overlap"))
