"""Graph queries; their graphs are the cluster graph and the neighbour graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph, knn, novelty
from skein.plans.recursive import BETWEENNESS, BETWEENNESS_BY_LENGTH, eigenvector_sql, hops_sql, lengths_sql, pagerank_sql, reached_sql, river_sql
from skein.plans.registry import query, r6, rounded
from skein.plans.topics import SQL_CENTROID
from skein.plans.vectors import SQL_KNN
from skein.sources.adapters import SQL_PAPERS, papers, read

SQL_TOPIC = f"""{SQL_PAPERS}, {SQL_CENTROID}, cc AS (SELECT a.cluster_id AS src, b.cluster_id AS dst, list_cosine_similarity(a.u, b.u) AS w FROM cu a JOIN cu b ON a.cluster_id <> b.cluster_id),
tk AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5), tg AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS weight FROM tk WHERE w >= 0.02 GROUP BY ALL)"""
SQL_UND = "ue AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(score) AS weight FROM kn GROUP BY ALL), be AS (SELECT src, dst, weight FROM ue UNION ALL SELECT dst, src, weight FROM ue)"


def _topic(spark, sf_dir):
    return graph.topic_graph(novelty.centroid_unit(papers(spark, sf_dir)), least=0.02)


def _edges(spark, sf_dir):
    return knn.knn(papers(spark, sf_dir)).select("src", "dst", F.col("score").alias("weight"))


def _nodes(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("paper_id").alias("node"))


@query(f"WITH {SQL_TOPIC} SELECT src, dst, {r6('weight')} AS weight FROM tg")
def topic_graph(spark, sf_dir):
    return rounded(_topic(spark, sf_dir), "weight")


@query(f"WITH {SQL_KNN}, ke AS (SELECT src, dst, greatest(score, 0) AS weight FROM kn), kd AS (SELECT paper_id AS node FROM papers), {pagerank_sql('ke', 'kd', 60)} SELECT node, round(r, 8) + 0.0 AS rank FROM p60")
def pagerank(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    return rounded(graph.pagerank(e, _nodes(spark, sf_dir)), "rank", digits=8)


@query(f"WITH {SQL_KNN}, ke AS (SELECT src, dst, greatest(score, 0) AS weight FROM kn), kd AS (SELECT paper_id AS node FROM papers), {eigenvector_sql('ke', 'kd')} SELECT node, {r6('v')} AS centrality FROM v80")
def eigenvector_centrality(spark, sf_dir):
    return rounded(graph.eigenvector(_edges(spark, sf_dir), _nodes(spark, sf_dir)), "centrality")


@query(f"""WITH RECURSIVE {SQL_KNN}, {SQL_UND}, strong AS (SELECT src, dst FROM be WHERE weight >= 0.36), reach(node, other) AS (SELECT paper_id, paper_id FROM papers UNION SELECT reach.node, strong.dst FROM reach JOIN strong ON reach.other = strong.src)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def connected_components(spark, sf_dir):
    e = _edges(spark, sf_dir).where("weight >= 0.36")
    return graph.components(e, _nodes(spark, sf_dir))


@query(f"""WITH {SQL_KNN}, {SQL_UND}, dg AS (SELECT src AS node, count(*) AS degree FROM be GROUP BY ALL),
tr AS (SELECT x.src AS node, count(*) AS t FROM be x JOIN be y ON x.dst = y.src JOIN be z ON z.src = x.src AND z.dst = y.dst GROUP BY ALL)
SELECT node, degree, {r6('CASE WHEN degree >= 2 THEN coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END')} AS clustering FROM dg LEFT JOIN tr USING (node)""")
def local_clustering(spark, sf_dir):
    return rounded(graph.local_clustering(_edges(spark, sf_dir)), "clustering")


@query(f"""WITH {SQL_KNN}, {SQL_UND}, sp AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM be),
ii AS (SELECT a.src, b.dst, sum(a.p * b.p) AS i FROM sp a JOIN sp b ON a.dst = b.src GROUP BY ALL)
SELECT sp.src AS node, {r6('sum((p + coalesce(i, 0)) ** 2)')} AS constraint_sum, {r6('sum(1 - coalesce(i, 0))')} AS effective_size FROM sp LEFT JOIN ii ON ii.src = sp.src AND ii.dst = sp.dst GROUP BY sp.src""")
def structural_holes(spark, sf_dir):
    return rounded(graph.structural_holes(_edges(spark, sf_dir)).withColumnRenamed("constraint", "constraint_sum"), "constraint_sum", "effective_size")


SQL_TOPIC_BOTH = f"{SQL_TOPIC}, tb AS (SELECT src, dst FROM tg UNION ALL SELECT dst, src FROM tg), {hops_sql('tb', 8)}, {BETWEENNESS}, bt AS (SELECT node, CASE WHEN n > 2 THEN b * 2.0 / ((n - 1) * (n - 2)) ELSE 0 END AS betweenness FROM between)"


@query(f"WITH {SQL_TOPIC_BOTH} SELECT node, {r6('betweenness')} AS betweenness FROM bt")
def betweenness(spark, sf_dir):
    return rounded(graph.betweenness(_topic(spark, sf_dir)), "betweenness")


@query(f"WITH {SQL_KNN}, ue AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(1 - score) AS weight FROM kn GROUP BY ALL), be AS (SELECT src, dst, weight FROM ue UNION ALL SELECT dst, src, weight FROM ue), {lengths_sql('be', 10)}, {BETWEENNESS_BY_LENGTH} SELECT node, b + 0.0 AS betweenness FROM between")
def betweenness_weighted(spark, sf_dir):
    return rounded(graph.betweenness(_edges(spark, sf_dir).withColumn("weight", 1 - F.col("weight")), weighted=True), "betweenness")


@query(f"""WITH {SQL_TOPIC_BOTH}, dg AS (SELECT src AS node, count(*) AS degree FROM tb GROUP BY ALL), tr AS (SELECT x.src AS node, count(*) AS t FROM tb x JOIN tb y ON x.dst = y.src JOIN tb z ON z.src = x.src AND z.dst = y.dst GROUP BY ALL),
lc AS (SELECT node, degree, CASE WHEN degree >= 2 THEN coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM dg LEFT JOIN tr USING (node))
SELECT node, degree, {r6('betweenness')} AS betweenness, {r6('clustering')} AS clustering, {r6('betweenness * (1 - clustering)')} AS bridging FROM bt JOIN lc USING (node)""")
def bridging_clusters(spark, sf_dir):
    return rounded(graph.bridging(_topic(spark, sf_dir)), "betweenness", "clustering", "bridging")


@query(f"""WITH {SQL_KNN}, c AS (SELECT src, cluster_id, count(*) AS n FROM kn JOIN papers ON paper_id = dst GROUP BY ALL), s AS (SELECT src, cluster_id, n / sum(n) OVER (PARTITION BY src) AS p FROM c)
SELECT src AS paper_id, {r6('sum(-p * ln(p + 1e-12)) / ln(greatest(2, (SELECT count(DISTINCT cluster_id) FROM papers)))')} AS recombination, array_to_string(list(cluster_id ORDER BY p DESC, cluster_id)[1:3], ',') AS top_clusters FROM s GROUP BY ALL""")
def recombination(spark, sf_dir):
    p = papers(spark, sf_dir)
    return rounded(graph.recombination(knn.knn(p), p).withColumn("top_clusters", F.array_join(F.col("top_clusters").cast("array<string>"), ",")), "recombination")


@query(f"WITH {SQL_KNN} SELECT a.cluster_id AS src_cluster, b.cluster_id AS dst_cluster, {r6('sum(score)')} AS weight, count(*) AS n FROM kn JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst GROUP BY ALL")
def cluster_edges(spark, sf_dir):
    return rounded(graph.cluster_edges(_edges(spark, sf_dir), papers(spark, sf_dir)), "weight")


@query(f"""WITH RECURSIVE {SQL_KNN}, bf(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, hops + 1 FROM bf JOIN kn ON src = node WHERE hops < 4)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM bf GROUP BY ALL""")
def reachable_papers(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir), _nodes(spark, sf_dir).where("node = 0"), 4).select("node", "hops")


@query(f"""WITH RECURSIVE {SQL_KNN}, {reached_sql('kn', '0', 6)}, way AS (SELECT node, hops, via FROM (SELECT * FROM found WHERE node IN (7, 17, 27) ORDER BY hops, node LIMIT 1) UNION ALL SELECT f.node, f.hops, f.via FROM way JOIN found f ON f.node = way.via)
SELECT hops AS step, node FROM way""")
def influence_path(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    found = graph.path(_edges(spark, sf_dir), n.where("node = 0"), n.where("node IN (7, 17, 27)"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(found)], "step int, node long")


@query(f"WITH {SQL_KNN}, ke AS (SELECT src, dst, score AS weight FROM kn), {river_sql('ke', '0', 5)} SELECT step, node FROM river")
def idea_river(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, x in enumerate(graph.idea_river(_edges(spark, sf_dir), 0))], "step int, node long")


SQL_CITES = "ct AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst, 1.0 AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _cites(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


@query(f"WITH {SQL_CITES} SELECT x.src AS a, y.src AS b, count(DISTINCT x.dst) AS shared FROM ct x JOIN ct y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL ORDER BY shared DESC, a, b LIMIT 120")
def bibliographic_coupling(spark, sf_dir):
    return graph.coupling(_cites(spark, sf_dir))


@query(f"WITH {SQL_CITES} SELECT x.dst AS a, y.dst AS b, count(DISTINCT x.src) AS shared FROM ct x JOIN ct y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL ORDER BY shared DESC, a, b LIMIT 120")
def co_citation(spark, sf_dir):
    return graph.co_citation(_cites(spark, sf_dir))


@query(f"""WITH {SQL_KNN}, ke AS (SELECT src, dst, greatest(score, 0) AS weight FROM kn), kd AS (SELECT paper_id AS node FROM papers), {pagerank_sql('ke', 'kd', 60)}
SELECT p60.node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, round(r, 8) + 0.0 AS rank FROM p60 LEFT JOIN (SELECT dst, count(*) AS n FROM ke GROUP BY ALL) i ON i.dst = p60.node LEFT JOIN (SELECT src, count(*) AS n FROM ke GROUP BY ALL) o ON o.src = p60.node""")
def citation_metrics(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    return rounded(graph.citation_metrics(e, _nodes(spark, sf_dir)), "rank", digits=8)
