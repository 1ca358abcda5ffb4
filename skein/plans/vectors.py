"""Vector, neighbour, whitening and clustering queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import cluster, graph, knn, novelty
from skein.plans.registry import query, r6, rounded
from skein.plans.topics import SQL_CENTROID
from skein.sources.adapters import SQL_PAPERS, papers

SQL_KNN = f"""{SQL_PAPERS}, sm AS (SELECT a.paper_id AS src, b.paper_id AS dst, list_cosine_similarity(a.embedding, b.embedding) AS score FROM papers a JOIN papers b ON a.paper_id <> b.paper_id),
kn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank, score FROM sm QUALIFY rank <= 8)"""


@query(f"WITH {SQL_KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank, {r6('score')} AS score FROM kn")
def knn_graph(spark, sf_dir):
    return rounded(knn.knn(papers(spark, sf_dir)), "score")


@query(f"WITH {SQL_KNN} SELECT src AS paper_id, {r6('sum(score)')} AS degree, {r6('avg(score)')} AS mean_score FROM kn GROUP BY ALL")
def weighted_degree(spark, sf_dir):
    return graph.weighted_degree(knn.knn(papers(spark, sf_dir)))


@query(f"""WITH {SQL_PAPERS}, q AS (SELECT embedding AS q FROM papers WHERE paper_id = 0)
SELECT paper_id, {r6('list_cosine_similarity(embedding, q)')} AS score FROM papers, q ORDER BY list_cosine_similarity(embedding, q) DESC, paper_id LIMIT 10""")
def nearest_to_vector(spark, sf_dir):
    p = papers(spark, sf_dir)
    q = p.where("paper_id = 0").first()["embedding"]
    return rounded(knn.nearest_to(p, q, 10), "score")


@query(f"WITH {SQL_PAPERS}, e AS (SELECT unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM papers) SELECT CAST(i AS INTEGER) AS i, {r6('avg(x)')} AS mean FROM e GROUP BY ALL")
def mean_embedding(spark, sf_dir):
    return rounded(novelty.global_mean(papers(spark, sf_dir)).select(F.posexplode("global_mean").alias("i", "mean")), "mean")


@query(f"WITH {SQL_PAPERS}, {SQL_CENTROID} SELECT cluster_id, CAST(unnest(range(0, len(u))) AS INTEGER) AS i, {r6('unnest(u)')} AS x FROM cu")
def unit_centroids(spark, sf_dir):
    return rounded(novelty.centroid_unit(papers(spark, sf_dir)).select("cluster_id", F.posexplode("centroid").alias("i", "x")), "x")


@query(f"""WITH {SQL_PAPERS}, {SQL_CENTROID} SELECT a.cluster_id AS a, b.cluster_id AS b, {r6('list_cosine_similarity(a.u, b.u)')} AS cosine, {r6('list_distance(a.u, b.u)')} AS distance FROM cu a JOIN cu b ON a.cluster_id < b.cluster_id""")
def centroid_similarity(spark, sf_dir):
    c = novelty.centroid_unit(papers(spark, sf_dir))
    a, b = c.select(F.col("cluster_id").alias("a"), F.col("centroid").alias("x")), c.select(F.col("cluster_id").alias("b"), F.col("centroid").alias("y"))
    return rounded(a.join(b, F.col("a") < F.col("b")).select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("cosine"), V.distance(F.col("x"), F.col("y")).alias("distance")), "cosine", "distance")


@query(f"WITH {SQL_PAPERS} SELECT paper_id, {r6('list_sum(list_concat(embedding, [0.0, 0.0])[1:65])')} AS padded, {r6('list_sum(embedding[1:10])')} AS cut FROM papers")
def fitted_dimensions(spark, sf_dir):
    total = lambda d: F.aggregate(V.fit_dimension(F.col("embedding"), d), F.lit(0.0), lambda s, x: s + x)
    return papers(spark, sf_dir).select("paper_id", F.round(total(65), 6).alias("padded"), F.round(total(10), 6).alias("cut"))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS t FROM documents), b AS (SELECT doc_id AS paper_id, CAST((instr('0123456789abcdef', md5(t)[7]) - 1) * 16 + instr('0123456789abcdef', md5(t)[8]) - 1 AS INTEGER) AS i, count(*) AS n FROM w GROUP BY ALL)
SELECT paper_id, i, {r6('n / sqrt(sum(n * n) OVER (PARTITION BY paper_id))')} AS x FROM b""")
def hash_embedding(spark, sf_dir):
    e = cluster.hash_embedding(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("paper_id"), "text"))
    return rounded(e.select("paper_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0"), "x")


def _products(df, column, out):
    """i <= j and the mean product of elements i and j, over all rows."""
    each = df.select(F.posexplode(F.col(column)).alias("i", "x"), F.col(column).alias("v"))
    return each.select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j").groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias(out))


@query()
def whitened(spark, sf_dir):
    return knn.whiten(papers(spark, sf_dir))


@query("WITH d AS (SELECT unnest(range(0, len(any_value(embedding)))) AS i FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS covariance FROM d a JOIN d b ON a.i <= b.i")
def whitened_covariance(spark, sf_dir):
    """Whitened vectors have the identity as covariance, whichever way their axes point."""
    return rounded(_products(knn.whiten(papers(spark, sf_dir)), "embedding", "covariance"), "covariance").withColumn("covariance", F.col("covariance") + 0.0)


@query()
def factor_loadings(spark, sf_dir):
    return knn.factor_loadings(papers(spark, sf_dir))


@query("SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, a.i = b.i AS related FROM range(0, 8) a(i) JOIN range(0, 8) b(i) ON a.i <= b.i")
def factor_covariance(spark, sf_dir):
    """Loadings on different factors are uncorrelated."""
    return _products(knn.factor_loadings(papers(spark, sf_dir)), "loadings", "c").select("i", "j", (F.abs("c") > 1e-9).alias("related"))


@query()
def kmeans_clusters(spark, sf_dir):
    return cluster.kmeans(papers(spark, sf_dir), 10)


@query()
def two_level_galaxy(spark, sf_dir):
    return cluster.galaxy(papers(spark, sf_dir))


@query("SELECT vec_id AS paper_id, 1 AS rows, true AS placed FROM embeddings")
def galaxy_assignment(spark, sf_dir):
    """Each paper is in one cluster of each level, numbered within bounds."""
    g = cluster.galaxy(papers(spark, sf_dir))
    return g.groupBy("paper_id").agg(F.count("*").cast("int").alias("rows"), F.bool_and(F.col("mega_id").between(0, 7) & F.col("sub_id").between(0, 19)).alias("placed"))


@query()
def cluster_stability(spark, sf_dir):
    return cluster.jitter_stability(papers(spark, sf_dir), trials=4)


@query()
def cluster_seed_stability(spark, sf_dir):
    return cluster.seed_stability(papers(spark, sf_dir), runs=3)


@query()
def layout_quality(spark, sf_dir):
    return cluster.layout_quality(papers(spark, sf_dir))


@query()
def force_layout(spark, sf_dir):
    return cluster.force_layout(novelty.centroid_unit(papers(spark, sf_dir)))


@query()
def novelty_uncertainty(spark, sf_dir):
    return cluster.novelty_uncertainty(papers(spark, sf_dir))
