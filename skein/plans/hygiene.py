"""Upserts, worklists, audits, exports and layouts."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vector as V
from skein.operators import claims, cluster, entities, graph, hygiene, knn, recommend
from skein.plans.registry import query, r6, rounded
from skein.plans.vectors import SQL_KNN
from skein.sources import readers, sinks
from skein.sources.adapters import SQL_PAPERS, SQL_TEXTS, papers, read, texts


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_event(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return hygiene.newest(e, "user_id", "at").select("user_id", "event_id")


@query("SELECT o_orderkey AS file_path FROM orders WHERE o_orderkey NOT IN (SELECT DISTINCT l_orderkey FROM lineitem, orders WHERE o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_quantity >= 45)")
def unprocessed_files(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"), F.col("o_orderdate").alias("mtime"))
    done = read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("file_path"), F.col("l_shipdate").alias("ingested_at"), F.lit("s").alias("summary"), F.array(F.lit(1.0)).alias("embedding"))
    return hygiene.unprocessed(files, done).select("file_path")


@query(f"""WITH {SQL_TEXTS}, t AS (SELECT paper_id, list_filter(string_split(summary, chr(10)), lambda s: length(trim(s)) > 0) AS k FROM texts), a AS (SELECT paper_id, CASE WHEN len(k) < 3 OR len(k) > 5 THEN 'takeaway_count' END AS kind FROM t UNION ALL SELECT paper_id, CASE WHEN paper_id % 10 = 0 THEN 'missing_note' END FROM t)
SELECT kind, count(*) AS n FROM a WHERE kind IS NOT NULL GROUP BY ALL""")
def artifact_audit(spark, sf_dir):
    t = texts(spark, sf_dir).select("paper_id", F.filter(F.split("summary", "\n"), lambda s: F.length(F.trim(s)) > 0).alias("takeaways"), F.lit(5.0).alias("usability"))
    return hygiene.audit(t, t.where("paper_id % 10 <> 0")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_PAPERS}, m AS (SELECT doc_id AS paper_id, CAST(doc_id % 6 AS INTEGER) AS c FROM documents WHERE doc_id % 3 = 0) SELECT paper_id, coalesce(c, cluster_id) AS cluster_id FROM papers LEFT JOIN m USING (paper_id)")
def attached_clusters(spark, sf_dir):
    m = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.lit(0).alias("level"), (F.col("doc_id") % 6).cast("int").alias("cluster_id"), F.col("doc_id").alias("paper_id"))
    return readers.attach_clusters(papers(spark, sf_dir), m).select("paper_id", "cluster_id")


@query("SELECT p_partkey AS paper_id, unnest(list_filter(list_transform(string_split(p_type, ' '), lambda s: trim(s)), lambda s: s <> '')) AS value FROM part")
def exploded_tags(spark, sf_dir):
    return sinks.exploded_tags(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), F.split("p_type", " ").alias("tags")), "tags")


def _graph(spark, sf_dir):
    t = texts(spark, sf_dir).select("paper_id", "title", F.col("topic").alias("cluster_id"), F.array("lang").alias("tags"))
    c = t.where("paper_id % 2 = 0").select("paper_id", F.col("paper_id").alias("claim_id"), F.col("title").alias("statement"))
    e = c.where("paper_id % 4 = 0").select(F.col("paper_id").alias("src"), (F.col("paper_id") + 2).alias("dst"), F.lit("supports").alias("kind"))
    return sinks.knowledge_graph(t, c, e)


@query("""SELECT 'paper' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'cluster', count(DISTINCT source) FROM documents UNION ALL SELECT 'tag', count(DISTINCT lang) FROM documents UNION ALL SELECT 'claim', count(*) FROM documents WHERE doc_id % 2 = 0""")
def knowledge_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'belongsTo' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'tagged', count(*) FROM documents UNION ALL SELECT 'claims', count(*) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'supports', count(*) FROM documents WHERE doc_id % 4 = 0""")
def knowledge_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank, {r6('score')} AS score FROM kn WHERE rank <= 5")
def related_papers(spark, sf_dir):
    return rounded(knn.related(knn.knn(papers(spark, sf_dir))), "score")


@query(f"""WITH {SQL_PAPERS}, s AS (SELECT min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1 FROM papers),
c AS (SELECT CAST(least(9, floor((embedding[1] - x0) / (x1 - x0) * 10)) AS INTEGER) AS x_bin, CAST(least(9, floor((embedding[2] - y0) / (y1 - y0) * 10)) AS INTEGER) AS y_bin, abs(embedding[3]) AS d FROM papers, s),
g AS (SELECT x_bin, y_bin, count(*) AS n, avg(d) AS m FROM c GROUP BY ALL ORDER BY m DESC, n DESC, x_bin, y_bin LIMIT 120) SELECT x_bin, y_bin, n, {r6('m')} AS mean_distortion FROM g""")
def layout_grid(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("v", V.as_double(F.col("embedding")))
    return rounded(cluster.layout_grid(p.select("paper_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), p.select("paper_id", F.abs(F.col("v")[2]).alias("distortion"))), "mean_distortion")


@query(f"WITH {SQL_TEXTS} SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY year DESC, paper_id) AS INTEGER) AS r, paper_id, title FROM texts QUALIFY r <= 3")
def cluster_insights(spark, sf_dir):
    return cluster.insights(texts(spark, sf_dir).select("topic", "year", "paper_id", "title"), "topic")


@query()
def factor_labels(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("paper_id"), "text")
    return cluster.factor_labels(claims.tfidf(b, "paper_id", "text", 600))


@query(f"WITH {SQL_TEXTS} SELECT paper_id, trim(regexp_replace(summary, '\\s+', ' ', 'g')) = '' AS blank, length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS size FROM texts")
def collapsed_space(spark, sf_dir):
    return texts(spark, sf_dir).select("paper_id", (T.collapse(F.col("summary")) == "").alias("blank"), F.length(T.collapse(F.col("title"))).alias("size"))


@query("SELECT conv_id, replace(replace('{{role}}: {{text}}', '{{role}}', role), '{{text}}', substr(text, 1, 20)) AS prompt, turn FROM conversations")
def filled_template(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", T.fill_template("{{role}}: {{text}}", {"role": F.col("role"), "text": F.substring("text", 1, 20)}).alias("prompt"), "turn")


@query("SELECT count(*) FILTER (c_acctbal >= 0) AS active, count(*) FILTER (c_acctbal < 0) AS archived, count(*) FILTER (c_acctbal > 5000) AS with_outcome, round(avg(c_acctbal) FILTER (c_acctbal > 5000), 4) AS mean_sharpe FROM customer")
def strategy_summary(spark, sf_dir):
    s = read(spark, sf_dir, "customer").select((F.col("c_acctbal") < 0).alias("archived"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("sharpe"))
    return rounded(entities.strategy_summary(s), "mean_sharpe", digits=4)


@query(f"WITH {SQL_TEXTS} SELECT paper_id, CASE WHEN substr(title, 1, 120) <> '' THEN trim(substr(trim(title), 1, 120)) ELSE 'doc' END AS title FROM texts WHERE trim(title) = title AND title <> ''")
def inferred_titles(spark, sf_dir):
    t = texts(spark, sf_dir).where("trim(title) = title AND title <> ''")
    return t.select("paper_id", T.infer_title(F.lit(None).cast("string"), F.col("summary"), F.lit("doc.pdf")).alias("title"))


@query(f"""WITH {SQL_KNN}, d AS (SELECT src AS paper_id, round(sum(score), 6) AS degree FROM kn GROUP BY ALL), z AS (SELECT paper_id, (degree - avg(degree) OVER ()) / stddev_pop(degree) OVER () AS z FROM d)
SELECT paper_id, {r6('0.6 * z')} AS structural_consensus, {r6('0.36 * z')} AS consensus_total FROM z""")
def paper_metrics(spark, sf_dir):
    from skein.operators import novelty

    p = papers(spark, sf_dir)
    z = novelty.z_scores(graph.weighted_degree(knn.knn(p)), "degree").select("paper_id", F.col("z").alias("z_degree"))
    empty = p.select("paper_id").where("false")
    parts = [z, *(empty.withColumn(c, F.lit(0.0)) for c in ("z_eigen", "in_strength", "out_strength", "claim_consensus", "cluster_consensus"))]
    return rounded(hygiene.structural_consensus(hygiene.merge_metrics(p.select("paper_id"), parts)).select("paper_id", "structural_consensus", "consensus_total"), "structural_consensus", "consensus_total")


@query()
def summary_document(spark, sf_dir):
    from skein.operators import topics

    p = papers(spark, sf_dir)
    return sinks.summary({"topic_trends": (topics.topic_trends(p), ["cluster_id", "year"]), "coverage": (topics.mean_year(p), ["cluster_id"])})


@query("""WITH p AS (SELECT o_orderkey AS paper_id, o_totalprice AS novelty, CAST(o_custkey % 997 AS DOUBLE) AS consensus FROM orders), r AS (SELECT *, max(consensus) OVER (ORDER BY novelty DESC, consensus DESC, paper_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
SELECT paper_id, novelty, consensus FROM r WHERE b IS NULL OR consensus > b""")
def pareto_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_totalprice").alias("novelty"), (F.col("o_custkey") % 997).cast("double").alias("consensus"))
    return recommend.pareto(o)


@query(f"""WITH {SQL_PAPERS}, t AS (SELECT embedding AS t FROM papers WHERE paper_id = 4), s AS (SELECT paper_id, CASE WHEN paper_id % 10 = 0 THEN 'known' ELSE 'unread' END AS kind, list_cosine_similarity(embedding, t) AS c FROM papers, t)
SELECT kind, paper_id, {r6('c')} AS score, CAST(row_number() OVER (PARTITION BY kind ORDER BY c DESC, paper_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def knowledge_snapshot(spark, sf_dir):
    p = papers(spark, sf_dir)
    topic = p.where("paper_id = 4").first()["embedding"]
    return rounded(recommend.knowledge_snapshot(p, p.where("paper_id % 10 = 0"), topic), "score")


@query(f"WITH {SQL_PAPERS} SELECT CAST(cluster_id % 3 AS INTEGER) AS parent_id, cluster_id, paper_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY year DESC, paper_id) AS INTEGER) AS place FROM papers")
def subtopic_papers(spark, sf_dir):
    p = papers(spark, sf_dir)
    return recommend.papers_of(p.select("cluster_id", (F.col("cluster_id") % 3).alias("parent_id")).distinct(), p)


@query(f"WITH {SQL_KNN}, d AS (SELECT src AS paper_id, round(sum(score), 6) AS degree FROM kn GROUP BY ALL) SELECT cluster_id, {r6('avg(degree)')} AS mean_degree FROM papers JOIN d USING (paper_id) GROUP BY ALL")
def average_degree(spark, sf_dir):
    p = papers(spark, sf_dir)
    return rounded(recommend.average_degree(graph.weighted_degree(knn.knn(p)), p), "mean_degree")


@query(f"""WITH {SQL_PAPERS}, el AS (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers) GROUP BY ALL), c AS (SELECT cluster_id, list(m ORDER BY i) AS h FROM el GROUP BY ALL),
nh AS (SELECT a.cluster_id, b.cluster_id AS o FROM c a JOIN c b ON a.cluster_id <> b.cluster_id QUALIFY row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_distance(a.h, b.h), b.cluster_id) <= 4),
nl AS (SELECT a.cluster_id, b.cluster_id AS o FROM c a JOIN c b ON a.cluster_id <> b.cluster_id QUALIFY row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_distance(a.h[1:2], b.h[1:2]), b.cluster_id) <= 4)
SELECT c.cluster_id, {r6('count(nl.o) / 4')} AS overlap, {r6('1 - count(nl.o) / 4')} AS distortion FROM c LEFT JOIN nh ON nh.cluster_id = c.cluster_id LEFT JOIN nl ON nl.cluster_id = nh.cluster_id AND nl.o = nh.o GROUP BY c.cluster_id""")
def cluster_map_quality(spark, sf_dir):
    from skein.operators import novelty

    c = novelty.centroid_mean(papers(spark, sf_dir))
    return rounded(cluster.neighbour_overlap(c, c.select("cluster_id", F.slice("centroid", 1, 2).alias("centroid")), 4), "overlap", "distortion")
