"""Notes, strategies, pins, written texts and loaders."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import graph, knn, notes, novelty, recommend
from skein.plans.recursive import reached_sql, river_sql
from skein.plans.registry import query, r6, rounded
from skein.plans.topics import SQL_CENTROID
from skein.plans.vectors import SQL_KNN
from skein.sources import readers
from skein.sources.adapters import SQL_PAPERS, papers, read
from skein.sources.storage import cached, scratch

PART = "p_partkey"
SQL_NOTES = """nt AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 4 > 0 THEN '<!-- begin -->' ELSE '' END || chr(10) || 'format_version: ' || (1 + p_partkey % 2) || chr(10) || 'in [[' || p_brand || ']]' || CASE WHEN p_partkey % 3 > 0 THEN '> [!info] Meta' ELSE '' END || '<!-- end -->' END AS text FROM part)"""


def _notes(spark, sf_dir):
    i = F.col(PART)
    text = F.concat(F.when(i % 4 > 0, "<!-- begin -->").otherwise(""), F.lit("\nformat_version: "), (1 + i % 2).cast("string"), F.lit("\nin [["), "p_brand", F.lit("]]"), F.when(i % 3 > 0, "> [!info] Meta").otherwise(""), F.lit("<!-- end -->"))
    return read(spark, sf_dir, "part").select(i.alias("paper_id"), F.when(i % 5 > 0, text).alias("text")).where("text IS NOT NULL")


@query(f"""WITH {SQL_NOTES}, s AS (SELECT paper_id, CASE WHEN text IS NULL THEN 'missing' WHEN NOT contains(text, 'format_version: 2' || chr(10)) THEN 'old_format' WHEN NOT contains(text, '[[Brand#' || (10 + paper_id % 46) || ']]') THEN 'changed_link' END AS reason FROM nt) SELECT * FROM s WHERE reason IS NOT NULL""")
def stale_notes(spark, sf_dir):
    i = F.col(PART)
    items = read(spark, sf_dir, "part").select(i.alias("paper_id"), F.concat(F.lit("[[Brand#"), (10 + i % 46).cast("string"), F.lit("]]")).alias("link"))
    return notes.stale_notes(items, _notes(spark, sf_dir))


@query(f"""WITH {SQL_NOTES}, f AS (SELECT paper_id, unnest(list_filter([CASE WHEN NOT contains(text, '<!-- begin -->') THEN 'missing_markers' END, CASE WHEN NOT contains(text, 'format_version: 2') THEN 'missing_format_version' END, CASE WHEN paper_id % 2 = 0 AND NOT contains(text, '> [!info] Meta') THEN 'missing_meta' END], lambda k: k IS NOT NULL)) AS kind FROM nt WHERE text IS NOT NULL)
SELECT 'notes/' || paper_id || '.md' AS path, kind FROM f""")
def note_findings(spark, sf_dir):
    n = _notes(spark, sf_dir).select(F.concat(F.lit("notes/"), F.col("paper_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("paper_id") % 2 == 0, "papers").otherwise("clusters").alias("folder"), "text")
    return notes.note_findings(n, limit=None)


@query("SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'a/' ELSE 'b/' END || p_name || ' [' || p_partkey || '].md' AS path FROM part WHERE p_partkey % 7 > 0")
def note_paths(spark, sf_dir):
    i = F.col(PART)
    part = read(spark, sf_dir, "part")
    files = part.where("p_partkey % 7 > 0").select(F.concat(F.when(i % 2 == 0, "a/").otherwise("b/"), "p_name", F.lit(" ["), i.cast("string"), F.lit("].md")).alias("path")).unionByName(part.select(F.concat("p_name", F.lit(" ["), i.cast("string"), F.lit("].txt")).alias("path")))
    return notes.notes_of(files, part.select(i.alias("paper_id")))


@query("SELECT o_orderkey AS paper_id, coalesce(c_name, CAST(o_orderkey AS VARCHAR)) AS title, o_orderpriority AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_orderkey")
def failure_list(spark, sf_dir):
    failed = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("error"))
    return notes.failures(failed, read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title")))


SQL_DRAFTS = """dr AS (SELECT 'strategy-' || p_partkey AS strategy_id, CASE WHEN p_partkey % 6 = 0 THEN 'Strategy project' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Buy ' || p_partkey WHEN p_partkey % 3 = 1 THEN 'Step one.' ELSE 'Sum of ' || p_partkey || '.' END AS idea, CASE WHEN p_partkey % 2 = 0 THEN 'h1|h2' ELSE '' END AS hypotheses FROM part)"""


def _drafts(spark, sf_dir, now):
    i = F.col(PART)
    p = read(spark, sf_dir, "part").select(i.alias("paper_id"), F.when(i % 6 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(i % 3 == 0, F.concat(F.lit(" Buy "), i.cast("string"))).alias("verdict"), F.when(i % 3 == 1, "Step one. Step two.").alias("blueprint"), F.concat(F.lit("Sum of "), i.cast("string"), F.lit(". More.")).alias("summary"), F.when(i % 2 == 0, F.array(F.lit(" h1"), F.lit(""), F.lit("h2 "))).otherwise(F.array(F.lit(" "))).alias("hypotheses"), F.array(F.lit("t")).alias("trading_tags"))
    return notes.strategies_from(p, F.lit(now).cast("timestamp"))


@query(f"WITH {SQL_DRAFTS} SELECT * FROM dr")
def drafted_strategies(spark, sf_dir):
    return _drafts(spark, sf_dir, "2024-01-01").select("strategy_id", "title", "idea", F.array_join("hypotheses", "|").alias("hypotheses"))


@query(f"WITH {SQL_DRAFTS} SELECT strategy_id, CASE WHEN CAST(strategy_id[10:] AS INTEGER) % 4 = 0 THEN 'changed' ELSE title END AS title FROM dr WHERE CAST(strategy_id[10:] AS INTEGER) % 10 > 0 UNION ALL SELECT 'strategy-new', 'New strategy'")
def kept_strategies(spark, sf_dir):
    """Strategies after some were changed, one was made and some deleted."""
    s = _drafts(spark, sf_dir, "2024-01-01")
    number = F.substring("strategy_id", 10, 20).cast("int")
    changed = s.where(number % 4 == 0).withColumn("title", F.lit("changed")).unionByName(s.limit(1).withColumns({"strategy_id": F.lit("strategy-new"), "title": F.lit("New strategy")}))
    after = notes.updated(s, changed, F.lit("2024-02-01").cast("timestamp"))
    return notes.deleted(after, s.where(number % 10 == 0)).select("strategy_id", "title")


@query("""WITH c AS (SELECT CAST(r_regionkey AS BIGINT) AS cluster_id, 0 AS level, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, 1, n_name FROM nation), ch AS (SELECT 100 + n_nationkey AS cluster_id, 'new ' || n_name AS name FROM nation WHERE n_nationkey % 3 = 0), tg AS (SELECT 100 + n_nationkey AS cluster_id FROM nation WHERE n_nationkey % 2 = 0), pn AS (SELECT cluster_id FROM c WHERE cluster_id % 5 = 0),
tp AS (SELECT cluster_id FROM pn WHERE cluster_id NOT IN (SELECT cluster_id FROM tg) UNION ALL SELECT cluster_id FROM tg WHERE cluster_id NOT IN (SELECT cluster_id FROM pn))
SELECT level, cluster_id, coalesce(ch.name, c.name) AS name, CASE WHEN ch.name IS NOT NULL THEN 'manual' ELSE 'auto' END AS name_source, cluster_id IN (SELECT cluster_id FROM tp) AS pinned FROM c LEFT JOIN ch USING (cluster_id)""")
def edited_galaxy(spark, sf_dir):
    """Clusters of two levels after renames and toggled pins, as they are exported."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nation = (F.lit(100) + F.col("n_nationkey")).cast("long")
    c = r.select(F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("name")).unionByName(n.select(F.lit(1).alias("level"), nation.alias("cluster_id"), F.col("n_name").alias("name"))).withColumns({"summary": F.lit("s"), "name_source": F.lit("auto")})
    changes = n.select(nation.alias("cluster_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" new "), "n_name")).otherwise(" ").alias("name"), F.lit(None).cast("string").alias("summary"))
    pins = notes.toggled(c.where("cluster_id % 5 = 0"), n.where("n_nationkey % 2 = 0").select(nation.alias("cluster_id")))
    return notes.galaxy_export(notes.renamed(c, changes), pins).select("level", "cluster_id", "name", "name_source", "pinned")


@query(f"""WITH {SQL_PAPERS}, {SQL_CENTROID}, g AS (SELECT CAST(cluster_id % 3 AS INTEGER) AS side, list('Topic ' || cluster_id ORDER BY cluster_id) AS n FROM cu GROUP BY ALL), m AS (SELECT side, list(m ORDER BY i) AS m FROM (SELECT CAST(cluster_id % 3 AS INTEGER) AS side, i, avg(x) AS m FROM (SELECT cluster_id, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS i FROM cu) GROUP BY ALL) GROUP BY side)
SELECT side, 'Bridge: ' || array_to_string(n, ' × ') AS title, 'This paper would bridge ' || array_to_string(n, ', ') || '. It builds on: ' || array_to_string(list_transform(n, lambda x: 'On ' || x || '.'), ' ') AS abstract, {r6('m[1] / sqrt(list_inner_product(m, m))')} AS first FROM g JOIN m USING (side)""")
def bridges(spark, sf_dir):
    c = novelty.centroid_unit(papers(spark, sf_dir)).withColumns({"side": (F.col("cluster_id") % 3).cast("int"), "name": F.concat(F.lit("Topic "), F.col("cluster_id").cast("string"))})
    got = notes.bridge(c.withColumn("summary", F.concat(F.lit("On "), "name", F.lit("."))), "side")
    return rounded(got.select("side", "title", "abstract", F.col("embedding")[0].alias("first")), "first")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), l AS (SELECT o_custkey, k, 'Author ' || k || ' (' || o_orderkey || '): ' || o_orderpriority || CASE WHEN k > 1 THEN chr(10) || 'Author ' || k || ' answers Author ' || (k - 1) || ' on its assumptions.' ELSE '' END AS line FROM p WHERE k <= 3), t AS (SELECT o_custkey, string_agg(line, chr(10) ORDER BY k) AS t FROM l GROUP BY ALL)
SELECT c_custkey AS cluster_id, CASE WHEN t IS NULL THEN 'No papers for ' || c_name || '.' ELSE 'Panel on ' || c_name || chr(10) || t END AS panel FROM customer LEFT JOIN t ON o_custkey = c_custkey""")
def panels(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("name"))
    return notes.panel(c, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderpriority").alias("claim")))


@query("""WITH p AS (SELECT a.n_nationkey AS id, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1)
SELECT id, 'Debate: ' || a || ' vs ' || b || chr(10) || 'Rounds: 2' || chr(10) || 'Round 1' || chr(10) || 'A (' || a || ') opening: On ' || a || '.' || chr(10) || 'B (' || b || ') opening: On ' || b || '.' || chr(10) || 'Round 2' || chr(10) || 'A (' || a || ') rebuttal: which assumptions of the other side may fail' || chr(10) || 'B (' || b || ') rebuttal: which assumptions of the other side may fail' AS debate FROM p""")
def debates(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    side = lambda d, key, name: d.select(key.alias("id"), F.struct(F.col("n_name").alias("title"), F.concat(F.lit("On "), "n_name", F.lit(". And more.")).alias("summary")).alias(name))
    return notes.debate(side(n, F.col("n_nationkey"), "a").join(side(n, F.col("n_nationkey") - 1, "b"), "id"), rounds=1)


@query("""SELECT o_custkey AS id, string_agg('Chunk ' || k || ': ' || o_orderpriority || ' ' || o_orderkey, chr(10) ORDER BY k) AS bullets FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY ALL""")
def chunk_bullets(spark, sf_dir):
    """Bullets that fit; how they shrink is tested by hand."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: F.concat(s["o_orderpriority"], F.lit("  "), s["o_orderkey"].cast("string"))).alias("c"))
    return o.select("id", notes.chunk_bullets(1_000_000)("c").alias("bullets"))


@query(f"WITH {SQL_PAPERS}, {SQL_CENTROID}, d AS (SELECT a.cluster_id AS src, b.cluster_id AS dst, list_distance(a.u, b.u) AS d FROM cu a JOIN cu b ON a.cluster_id <> b.cluster_id) SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY d, dst) AS INTEGER) AS rank FROM d QUALIFY rank <= 3")
def nearest_by_distance(spark, sf_dir):
    c = novelty.centroid_unit(papers(spark, sf_dir))
    a, b = c.select(F.col("cluster_id").alias("src"), F.col("centroid").alias("x")), c.select(F.col("cluster_id").alias("dst"), F.col("centroid").alias("y"))
    return knn.from_distances(a.crossJoin(b).select("src", "dst", V.distance(F.col("x"), F.col("y")).alias("distance")), 3)


@query(f"WITH {SQL_KNN}, ke AS (SELECT src, dst, score AS weight FROM kn JOIN papers ON paper_id = dst WHERE year BETWEEN 2003 AND 2012), {river_sql('ke', '0', 5)} SELECT step, node FROM river")
def idea_river_in_years(spark, sf_dir):
    p = papers(spark, sf_dir)
    e = knn.knn(p).select("src", "dst", F.col("score").alias("weight"))
    return spark.createDataFrame(list(enumerate(graph.idea_river(e, 0, nodes=p.select(F.col("paper_id").alias("node"), "year"), years=(2003, 2012)))), "step int, node long")


@query(f"""WITH RECURSIVE {SQL_KNN}, s AS (SELECT min(paper_id) AS node FROM papers WHERE paper_id % 50 = 1), {reached_sql('kn', '(SELECT node FROM s)', 6)}, way AS (SELECT node, hops, via FROM (SELECT * FROM found WHERE node % 50 = 2 ORDER BY hops, node LIMIT 1) UNION ALL SELECT f.node, f.hops, f.via FROM way JOIN found f ON f.node = way.via)
SELECT hops AS step, node FROM way""")
def claim_path(spark, sf_dir):
    p = papers(spark, sf_dir)
    side = F.when(F.col("paper_id") == 1, 1).when(F.col("paper_id") % 50 == 2, 2)
    c = p.select(F.col("paper_id").alias("claim_id"), side.alias("cluster_id"))
    return spark.createDataFrame(list(enumerate(graph.claim_path(knn.knn(p), c, 1, 2))), "step int, node long")


@query("""WITH v AS (SELECT event_id, user_id, ts, value FROM events) SELECT CAST(user_id AS VARCHAR) AS file_path, event_id AS paper_id, CASE WHEN 1890 + event_id % 200 BETWEEN 1900 AND 2025 THEN CAST(1890 + event_id % 200 AS INTEGER) ELSE 0 END AS year, 4 AS dim, {0} AS total, 'a' AS takeaways FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""".replace("{0}", r6("value")))
def loaded_papers(spark, sf_dir):
    """Papers of the newest file each, with plausible years, fitted vectors and clean takeaways."""
    e = read(spark, sf_dir, "events")
    p = e.select(F.col("user_id").cast("string").alias("file_path"), F.col("event_id").alias("paper_id"), F.struct("ts", "event_id").alias("mtime"), (F.lit(1890) + F.col("event_id") % 200).cast("int").alias("year"), F.array(F.col("value").cast("double")).alias("embedding"), F.array(F.lit("- a"), F.lit("todo")).alias("takeaways"))
    got = readers.load_papers(p, 2025, 4)
    return rounded(got.select("file_path", "paper_id", F.coalesce("year", F.lit(0)).alias("year"), F.size("embedding").alias("dim"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_join("takeaways", "|").alias("takeaways")), "total")


@query(f"WITH {SQL_PAPERS}, {SQL_CENTROID} SELECT cluster_id, {r6('u[1]')} AS first FROM cu")
def cached_centroids(spark, sf_dir):
    """A table built once for its key and then read."""
    folder, build = scratch(spark), lambda: novelty.centroid_unit(papers(spark, sf_dir)).select("cluster_id", F.col("centroid")[0].alias("first"))
    cached(spark, folder, "v1|10", build)
    return rounded(cached(spark, folder, "v1|10", lambda: build().limit(0)), "first")
