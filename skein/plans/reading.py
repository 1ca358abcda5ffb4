"""Reading log, recommendation, filter and trading-lens queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import graph, knn, novelty, recommend
from skein.plans.recursive import marginal_gain_sql
from skein.plans.registry import query, r6, rounded
from skein.plans.topics import SQL_CENTROID
from skein.plans.vectors import SQL_KNN
from skein.sources.adapters import SQL_EVENTS, SQL_PAPERS, SQL_TEXTS, events, papers, read, texts

AS_OF = "2024-07-01"
SQL_READ = f"""{SQL_PAPERS}, {SQL_EVENTS}, rs AS (SELECT paper_id, count(*) FILTER (event_type = 'opened') AS opens, count(*) FILTER (event_type = 'note_saved') AS notes, max(ts) FILTER (event_type = 'opened') AS last_open FROM log GROUP BY ALL),
rd AS (SELECT *, least(1.0, 1 - exp(-(0.55 * opens + 0.9 * notes))) AS read_score FROM rs)"""
SQL_COVER = f"{SQL_READ}, cv AS (SELECT cluster_id, avg(coalesce(read_score, 0)) AS coverage FROM papers LEFT JOIN rd USING (paper_id) GROUP BY ALL)"
SQL_INTEREST = f"""{SQL_COVER}, {SQL_CENTROID}, wo AS (SELECT embedding, exp(-greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(last_open)) / 86400.0) / 60.0) AS w FROM papers JOIN rd USING (paper_id) WHERE opens > 0),
it AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, sum(x * w) / sum(w) AS m FROM (SELECT w, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM wo) GROUP BY i))"""


def _scores(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    return recommend.read_scores(log)


@query(f"WITH {SQL_READ} SELECT paper_id, opens, notes, {r6('read_score')} AS read_score FROM rd")
def read_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).drop("last_open"), "read_score")


@query(f"WITH {SQL_COVER} SELECT cluster_id, {r6('coverage')} AS coverage FROM cv")
def cluster_coverage(spark, sf_dir):
    return rounded(recommend.coverage(papers(spark, sf_dir), _scores(spark, sf_dir)), "coverage")


@query(f"WITH {SQL_INTEREST}, s AS (SELECT cluster_id, coverage, greatest(0, list_cosine_similarity(u, q)) * (1 - coverage) AS b FROM cu JOIN cv USING (cluster_id), it) SELECT cluster_id, {r6('coverage')} AS coverage, round(b, 5) + 0.0 AS blindspot FROM s ORDER BY b DESC, cluster_id LIMIT 18")
def blind_spots(spark, sf_dir):
    p, s = papers(spark, sf_dir), _scores(spark, sf_dir)
    b = recommend.blind_spots(novelty.centroid_unit(p), recommend.coverage(p, s), recommend.interest(p, s, AS_OF))
    return rounded(rounded(b, "coverage"), "blindspot", digits=5)


@query("SELECT CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'note_saved' WHEN 'purchase' THEN 'rec_helpful' WHEN 'error' THEN 'rec_not_helpful' ELSE 'qa_question' END AS event_type, count(*) AS n, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY ALL")
def event_stats(spark, sf_dir):
    return recommend.event_stats(events(spark, sf_dir)).select("event_type", "n", F.unix_timestamp("last").alias("last"))


@query("""WITH q AS (SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS question, count(*) FILTER (event_type = 'signup') AS asked, count(*) FILTER (event_type = 'view') AS answered FROM events GROUP BY ALL)
SELECT question, asked, answered FROM q ORDER BY answered > 0, asked DESC, question LIMIT 80""")
def question_gaps(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "qa_question").when(F.col("event_type") == "view", "qa_answer_ready")
    return recommend.question_gaps(e.select(kind.alias("event_type"), F.get_json_object("props", "$.k").alias("q"))).select("question", "asked", "answered")


@query(f"""WITH {SQL_KNN}, {SQL_CENTROID}, dg AS (SELECT src AS paper_id, round(sum(score), 6) AS degree FROM kn GROUP BY ALL),
s AS (SELECT paper_id, 0.6 * (abs(embedding[1]) + abs(embedding[2]) + abs(embedding[3])) + 0.3 * list_distance(embedding, u) + 0.1 * degree AS score FROM papers JOIN cu USING (cluster_id) JOIN dg USING (paper_id))
SELECT paper_id, {r6('s.score')} AS score FROM s ORDER BY s.score DESC, paper_id LIMIT 10""")
def simple_recommendations(spark, sf_dir):
    p = papers(spark, sf_dir)
    load = p.select("paper_id", F.slice(V.as_double(F.col("embedding")), 1, 8).alias("loadings"))
    n = p.join(novelty.centroid_unit(p), "cluster_id").select("paper_id", V.distance(F.col("embedding"), F.col("centroid")).alias("cluster_novelty"))
    return rounded(recommend.simple_recommendations(load, n, graph.weighted_degree(knn.knn(p))), "score")


@query(f"""WITH {SQL_COVER}, {SQL_CENTROID}, sim AS MATERIALIZED (SELECT paper_id, cu.cluster_id AS i, greatest(0, list_cosine_similarity(embedding, u)) AS s, 1 - coverage AS w FROM papers, cu JOIN cv ON cv.cluster_id = cu.cluster_id),
pr AS (SELECT papers.paper_id, coalesce(read_score, 0) AS r FROM papers LEFT JOIN rd USING (paper_id)), tw AS (SELECT paper_id, sum(s * w) AS total FROM sim GROUP BY ALL),
pool AS MATERIALIZED (SELECT paper_id, row_number() OVER (ORDER BY total DESC, paper_id) AS place FROM tw JOIN pr USING (paper_id) WHERE r < 0.15 QUALIFY place <= 1200),
b0 AS MATERIALIZED (SELECT cu.cluster_id AS i, coalesce(max(s) FILTER (r >= 0.5), 0) AS best FROM cu JOIN sim ON sim.i = cu.cluster_id JOIN pr USING (paper_id) GROUP BY ALL), {marginal_gain_sql(8)} SELECT * FROM gains""")
def marginal_gain(spark, sf_dir):
    p, s = papers(spark, sf_dir), _scores(spark, sf_dir)
    return rounded(recommend.marginal_gain(novelty.centroid_unit(p), recommend.coverage(p, s), p, s), "gain")


@query(f"""WITH {SQL_KNN}, st AS (SELECT src, list(dst) AS s FROM kn WHERE rank <= 6 GROUP BY ALL)
SELECT k.src AS paper_id, {r6('avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))))')} AS confidence FROM kn k JOIN st a ON a.src = k.src JOIN st b ON b.src = k.dst WHERE k.rank <= 4 GROUP BY ALL""")
def answer_confidence(spark, sf_dir):
    return rounded(recommend.answer_confidence(knn.knn(papers(spark, sf_dir))), "confidence")


@query(f"WITH {SQL_PAPERS}, {SQL_CENTROID}, s AS (SELECT paper_id, least(list_cosine_similarity(embedding, a.u), list_cosine_similarity(embedding, b.u)) AS score FROM papers, cu a, cu b WHERE a.cluster_id = 0 AND b.cluster_id = 1) SELECT paper_id, {r6('s.score')} AS score FROM s ORDER BY s.score DESC, paper_id LIMIT 10")
def bridging_papers(spark, sf_dir):
    p = papers(spark, sf_dir)
    c = novelty.centroid_unit(p)
    ends = c.where("cluster_id = 0").select(F.col("centroid").alias("a")).crossJoin(c.where("cluster_id = 1").select(F.col("centroid").alias("b")))
    return rounded(recommend.bridging_papers(p.crossJoin(F.broadcast(ends)), F.col("a"), F.col("b")), "score")


SQL_RETRIEVE = f"""{SQL_PAPERS}, q AS (SELECT embedding AS q FROM papers WHERE paper_id = 3), cd AS (SELECT paper_id, list_cosine_similarity(embedding, q) AS score FROM papers, q ORDER BY score DESC, paper_id LIMIT 80),
ck AS (SELECT paper_id * 2 + c AS chunk_id, paper_id, CASE WHEN c = 0 THEN embedding ELSE list_transform(embedding, lambda x: x + 0.1) END AS embedding FROM papers, (SELECT unnest([0, 1]) AS c)),
ev AS (SELECT chunk_id, ck.paper_id, list_cosine_similarity(ck.embedding, q) AS score FROM ck, q WHERE ck.paper_id IN (SELECT paper_id FROM cd) ORDER BY score DESC, chunk_id LIMIT 24),
bp AS (SELECT paper_id, max(score) AS score, 0 AS f FROM ev GROUP BY ALL), al AS (SELECT * FROM bp UNION ALL SELECT paper_id, score, 1 FROM cd WHERE paper_id NOT IN (SELECT paper_id FROM bp))"""


@query(f"WITH {SQL_RETRIEVE} SELECT paper_id, {r6('al.score')} AS score, f = 1 AS filler FROM al ORDER BY f, al.score DESC, paper_id LIMIT 8")
def two_stage_retrieval(spark, sf_dir):
    p = papers(spark, sf_dir)
    q = p.where("paper_id = 3").first()["embedding"]
    c = p.select("paper_id", F.posexplode(F.array(V.as_double(F.col("embedding")), F.transform(V.as_double(F.col("embedding")), lambda x: x + 0.1))).alias("c", "embedding")).select((F.col("paper_id") * 2 + F.col("c")).alias("chunk_id"), "paper_id", "embedding")
    return rounded(recommend.retrieve(p, c, q)[0], "score")


SQL_PROFILE = f"""{SQL_PAPERS}, mg AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers) GROUP BY i)),
mp AS (SELECT list(m ORDER BY i) AS p FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers WHERE paper_id % 10 = 0) GROUP BY i))"""


def _read(spark, sf_dir):
    return papers(spark, sf_dir).where("paper_id % 10 = 0").select("paper_id")


@query(f"WITH {SQL_PROFILE}, s AS (SELECT paper_id, list_cosine_similarity(embedding, p) AS score FROM papers, mp WHERE paper_id % 10 <> 0) SELECT paper_id, {r6('s.score')} AS score FROM s ORDER BY s.score DESC, paper_id LIMIT 5")
def recommended_next(spark, sf_dir):
    return rounded(recommend.recommended_next(papers(spark, sf_dir), _read(spark, sf_dir)), "score")


@query(f"WITH {SQL_PROFILE}, s AS (SELECT paper_id, greatest(0, list_cosine_similarity(embedding, g) - list_cosine_similarity(embedding, p)) AS score FROM papers, mg, mp WHERE paper_id % 10 <> 0) SELECT paper_id, {r6('s.score')} AS score FROM s ORDER BY s.score DESC, paper_id LIMIT 5")
def profile_blind_spots(spark, sf_dir):
    return rounded(recommend.profile_blind_spots(papers(spark, sf_dir), _read(spark, sf_dir)), "score")


@query(f"""WITH {SQL_PAPERS}, rp AS (SELECT paper_id FROM papers WHERE paper_id % 10 = 0), pf AS (SELECT list(m ORDER BY i) AS p FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers WHERE paper_id IN (SELECT paper_id FROM rp)) GROUP BY i)),
tg AS (SELECT embedding AS t FROM papers WHERE paper_id = 5), rest AS MATERIALIZED (SELECT paper_id, list_cosine_similarity(embedding, p) AS cp, list_cosine_similarity(embedding, t) AS ct FROM papers, pf, tg WHERE paper_id NOT IN (SELECT paper_id FROM rp)),
fo AS MATERIALIZED (SELECT 'foundation' AS stage, paper_id, cp AS score FROM rest ORDER BY cp DESC, paper_id LIMIT 3), ad AS MATERIALIZED (SELECT 'advanced' AS stage, paper_id, ct - cp AS score FROM rest WHERE paper_id NOT IN (SELECT paper_id FROM fo) ORDER BY ct - cp DESC, paper_id LIMIT 2),
br AS (SELECT 'bridge' AS stage, paper_id, least(cp, ct) AS score FROM rest WHERE paper_id NOT IN (SELECT paper_id FROM fo) AND paper_id NOT IN (SELECT paper_id FROM ad) ORDER BY least(cp, ct) DESC, paper_id LIMIT 5)
SELECT stage, paper_id, {r6('score')} AS score FROM (SELECT * FROM fo UNION ALL SELECT * FROM ad UNION ALL SELECT * FROM br)""")
def curriculum(spark, sf_dir):
    p = papers(spark, sf_dir)
    target = p.where("paper_id = 5").first()["embedding"]
    return rounded(recommend.curriculum(p, _read(spark, sf_dir), target), "score")


def _lens(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("paper_id"), F.split("p_type", " ").alias("tags"), (F.lit(2000) + F.col("p_size") % 15).cast("int").alias("year"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("double")).alias("novelty"), (F.col("p_retailprice") % 10).alias("usability"), F.lit(None).cast("double").alias("strategy_impact"))


SQL_LENS = "ln AS (SELECT p_partkey AS paper_id, string_split(p_type, ' ') AS tags, CAST(2000 + p_size % 15 AS INTEGER) AS year, p_name AS title, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS novelty, p_retailprice % 10 AS usability FROM part), ex AS (SELECT DISTINCT paper_id, year, unnest(tags) AS value FROM ln)"


@query(f"WITH {SQL_LENS} SELECT value, count(*) AS n FROM ex GROUP BY ALL ORDER BY n DESC, value LIMIT 64")
def tag_rollup(spark, sf_dir):
    return recommend.tag_rollup(_lens(spark, sf_dir), "tags")


@query(f"WITH {SQL_LENS}, b AS (SELECT value FROM ex GROUP BY ALL ORDER BY count(*) DESC, value LIMIT 6) SELECT value, year, count(*) AS n FROM ex WHERE value IN (SELECT value FROM b) GROUP BY ALL")
def tag_trends(spark, sf_dir):
    return recommend.tag_trends(_lens(spark, sf_dir), "tags")


@query(f"WITH {SQL_LENS} SELECT DISTINCT value FROM ex")
def option_list(spark, sf_dir):
    return recommend.option_list(_lens(spark, sf_dir), "tags")


@query(f"WITH {SQL_LENS} SELECT paper_id FROM ln WHERE year BETWEEN 2003 AND 2009 AND contains(lower(title), '1') AND list_has_any(tags, (SELECT list(value) FROM (SELECT value FROM ex GROUP BY ALL ORDER BY count(*) DESC, value LIMIT 2)))")
def filtered_papers(spark, sf_dir):
    rows = _lens(spark, sf_dir)
    two = [r["value"] for r in recommend.tag_rollup(rows, "tags", 2).collect()]
    return recommend.keep_where(rows, (2003, 2009), search="1", search_columns=["title"], tags=two).select("paper_id")


@query(f"WITH {SQL_LENS} SELECT paper_id, CAST(row_number() OVER (ORDER BY coalesce(novelty, 0) DESC, paper_id) AS INTEGER) AS place FROM ln QUALIFY place <= 100")
def ordered_papers(spark, sf_dir):
    top = recommend.order_by(_lens(spark, sf_dir), "novelty").select("paper_id", F.coalesce("novelty", F.lit(0.0)).alias("k")).limit(100)
    return top.select("paper_id", F.row_number().over(Window.orderBy(F.desc("k"), "paper_id")).alias("place"))


@query("""WITH p AS (SELECT c_custkey AS paper_id, c_acctbal AS novelty, (c_custkey * 7919) % 1000 AS consensus FROM customer), r AS (SELECT *, max(consensus) OVER (ORDER BY novelty DESC, consensus DESC, paper_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
SELECT paper_id, novelty, CAST(consensus AS DOUBLE) AS consensus FROM r WHERE b IS NULL OR consensus > b""")
def pareto_frontier(spark, sf_dir):
    return recommend.pareto(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_acctbal").alias("novelty"), ((F.col("c_custkey") * 7919) % 1000).cast("double").alias("consensus")))


@query(f"WITH {SQL_KNN}, d AS (SELECT src AS paper_id, round(sum(score), 6) AS degree FROM kn GROUP BY ALL) SELECT paper_id, degree + 0.0 AS degree FROM d WHERE paper_id % 3 <> 0 ORDER BY degree DESC, paper_id LIMIT 5")
def central_not_recommended(spark, sf_dir):
    p = papers(spark, sf_dir)
    return recommend.central_not_recommended(graph.weighted_degree(knn.knn(p)), p.where("paper_id % 3 = 0")).select("paper_id", "degree")


@query(f"WITH {SQL_KNN}, d AS (SELECT src AS paper_id, round(sum(score), 6) AS degree FROM kn GROUP BY ALL) SELECT cluster_id, paper_id FROM papers JOIN d USING (paper_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY degree DESC, year DESC, paper_id) = 1")
def representative_papers(spark, sf_dir):
    p = papers(spark, sf_dir)
    return recommend.representative(p, graph.weighted_degree(knn.knn(p)))


@query(f"""WITH {SQL_PAPERS}, u AS (SELECT paper_id, 1 AS s FROM (SELECT * FROM papers ORDER BY year DESC, paper_id LIMIT 6) UNION ALL SELECT paper_id, 2 FROM (SELECT * FROM papers ORDER BY year, paper_id LIMIT 2) UNION ALL SELECT paper_id, 3 FROM (SELECT * FROM papers WHERE paper_id % 9 = 0 ORDER BY year DESC, paper_id LIMIT 4))
SELECT paper_id, CAST(min(s) AS INTEGER) AS section FROM u GROUP BY ALL ORDER BY section, paper_id LIMIT 12""")
def corpus_briefing(spark, sf_dir):
    return recommend.briefing(papers(spark, sf_dir).withColumn("is_important", F.col("paper_id") % 9 == 0))


@query("SELECT o_custkey AS strategy_id, o_totalprice AS sharpe FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_outcome(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("strategy_id"), F.col("o_totalprice").alias("sharpe"), F.struct("o_orderdate", "o_orderkey").alias("measured_at"))
    return recommend.latest_sharpe(o)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(f"WITH {SQL_TEXTS} SELECT topic, CAST(approx_count_distinct(lang) > 0 AS INTEGER) AS some, median(length(summary)) AS median_length, round(CAST(quantile_cont(length(summary), 0.9) AS DOUBLE), 4) AS p90 FROM texts GROUP BY ALL")
def length_quantiles(spark, sf_dir):
    t = texts(spark, sf_dir)
    return t.groupBy("topic").agg((F.approx_count_distinct("lang") > 0).cast("int").alias("some"), F.median(F.length("summary")).alias("median_length"), F.round(F.percentile(F.length("summary"), 0.9), 4).alias("p90"))
