"""Temporal queries over clusters."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.operators import knn, novelty, topics
from skein.plans.registry import query, r6, rounded
from skein.sources.adapters import SQL_EVENTS, SQL_PAPERS, SQL_SERIES, SQL_TEXTS, events, papers, priority_series, texts

MEAN = "list(m ORDER BY i)"
SQL_YEARLY = f"""el AS (SELECT cluster_id, year, i, avg(x) AS m FROM (SELECT cluster_id, year, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers) GROUP BY ALL),
yc AS (SELECT cluster_id, year, {MEAN} AS c FROM el GROUP BY ALL)"""
SQL_DRIFT = f"""{SQL_PAPERS}, {SQL_YEARLY},
st AS (SELECT *, lag(c) OVER w AS b, lag(year) OVER w AS from_year, count(*) OVER (PARTITION BY cluster_id) AS k FROM yc WINDOW w AS (PARTITION BY cluster_id ORDER BY year)),
dr AS (SELECT cluster_id, year, from_year, coalesce(list_distance(c, b), 0) AS drift, coalesce((c[1] - b[1]) / nullif(list_distance(c, b), 0), 0) AS dx, coalesce((c[2] - b[2]) / nullif(list_distance(c, b), 0), 0) AS dy FROM st WHERE k >= 2)"""
SQL_NEXT = "nx AS (SELECT cluster_id, year, c, lead(c) OVER w AS a, lead(year) OVER w AS to_year FROM yc WINDOW w AS (PARTITION BY cluster_id ORDER BY year)), dv AS (SELECT cluster_id, year, to_year, list_transform(range(1, len(c) + 1), lambda i: a[i] - c[i]) AS d FROM nx WHERE a IS NOT NULL)"
SQL_CENTROID = f"cm AS (SELECT cluster_id, {MEAN} AS m FROM (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers) GROUP BY ALL) GROUP BY ALL), cu AS (SELECT cluster_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS u FROM cm)"


@query(f"WITH {SQL_PAPERS} SELECT cluster_id, year, count(*) AS n FROM papers GROUP BY ALL")
def topic_trends(spark, sf_dir):
    return topics.topic_trends(papers(spark, sf_dir))


@query(f"WITH {SQL_DRIFT} SELECT cluster_id, year, coalesce(from_year, year) AS from_year, {r6('drift')} AS drift, {r6('dx')} AS dx, {r6('dy')} AS dy FROM dr")
def drift(spark, sf_dir):
    d = topics.drift(papers(spark, sf_dir)).withColumn("from_year", F.coalesce("from_year", "year"))
    return rounded(d, "drift", "dx", "dy")


@query(f"WITH {SQL_PAPERS}, {SQL_YEARLY}, {SQL_NEXT} SELECT cluster_id, year, to_year, {r6('sqrt(list_inner_product(d, d))')} AS size, {r6('d[1]')} AS first FROM dv")
def drift_vectors(spark, sf_dir):
    d = topics.drift_vectors(papers(spark, sf_dir))
    return d.select("cluster_id", "year", "to_year", F.round(V.norm(F.col("drift_vector")), 6).alias("size"), F.round(F.col("drift_vector")[0], 6).alias("first"))


@query(f"WITH {SQL_DRIFT} SELECT cluster_id, {r6('stddev_pop(drift)')} AS volatility, {r6('avg(drift)')} AS mean_drift FROM dr GROUP BY ALL")
def drift_volatility(spark, sf_dir):
    return rounded(topics.drift_volatility(topics.drift(papers(spark, sf_dir))), "volatility", "mean_drift")


@query(f"WITH {SQL_DRIFT} SELECT cluster_id, year, {r6('drift')} AS drift FROM dr QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY year DESC) = 1")
def latest_drift(spark, sf_dir):
    return rounded(topics.latest_drift(topics.drift(papers(spark, sf_dir))).select("cluster_id", "year", "drift"), "drift")


@query(f"WITH {SQL_DRIFT} SELECT cluster_id, year, {r6('drift')} AS drift FROM dr ORDER BY dr.drift DESC, cluster_id, year LIMIT 5")
def top_drift(spark, sf_dir):
    return rounded(topics.top_drift(topics.drift(papers(spark, sf_dir))).select("cluster_id", "year", "drift"), "drift")


@query(f"""WITH {SQL_PAPERS}, {SQL_YEARLY}, {SQL_NEXT}, {SQL_CENTROID},
g AS (SELECT {MEAN} AS g FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM papers) GROUP BY ALL))
SELECT paper_id, {r6('list_distance(embedding, u)')} AS cluster_novelty, {r6('list_distance(embedding, g)')} AS global_novelty,
coalesce({r6('list_cosine_similarity(list_transform(range(1, len(m) + 1), lambda i: embedding[i] - m[i]), d)')}, 0) AS directional_novelty
FROM papers JOIN cu USING (cluster_id) JOIN cm USING (cluster_id) CROSS JOIN g LEFT JOIN dv USING (cluster_id, year)""")
def novelty_scores(spark, sf_dir):
    return rounded(novelty.novelty(papers(spark, sf_dir)), "cluster_novelty", "global_novelty", "directional_novelty")


@query(f"""WITH {SQL_PAPERS}, {SQL_YEARLY}, {SQL_NEXT}
SELECT paper_id, {r6('list_cosine_similarity(list_transform(range(1, len(yc.c) + 1), lambda i: embedding[i] - yc.c[i]), d) * sqrt(list_inner_product(d, d))')} AS contribution
FROM papers JOIN yc USING (cluster_id, year) JOIN dv USING (cluster_id, year) WHERE list_distance(embedding, yc.c) > 0""")
def drift_contribution(spark, sf_dir):
    p = papers(spark, sf_dir)
    # a paper that is all of its cluster and year has no direction: its contribution is 0 and is left out
    alone = topics.topic_trends(p).where("n = 1").join(p, ["cluster_id", "year"]).select("paper_id")
    return rounded(novelty.drift_contribution(p).join(alone, "paper_id", "left_anti"), "contribution")


@query(f"SELECT event_id, {r6('(value - avg(value) OVER ()) / CASE WHEN stddev_pop(value) OVER () <= 1e-6 THEN 1 ELSE stddev_pop(value) OVER () END')} AS z FROM events")
def z_global(spark, sf_dir):
    return rounded(novelty.z_scores(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "value").select("event_id", "z"), "z")


@query(f"SELECT event_id, {r6('(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w <= 1e-6 THEN 1 ELSE stddev_pop(value) OVER w END')} AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def z_by_group(spark, sf_dir):
    return rounded(novelty.z_scores(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value"), "value", "event_type").select("event_id", "z"), "z")


SQL_AXIS = f"""{SQL_SERIES}, ct AS (SELECT cluster_id, year, count(*) AS n FROM series GROUP BY ALL),
ax AS (SELECT cluster_id, unnest(range((SELECT min(year) FROM ct), (SELECT max(year) FROM ct) + 1)) AS year FROM (SELECT DISTINCT cluster_id FROM ct)),
sr AS (SELECT cluster_id, year, coalesce(n, 0) AS n FROM ax LEFT JOIN ct USING (cluster_id, year)),
zz AS (SELECT *, coalesce((n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0), 0) AS z FROM sr WINDOW w AS (PARTITION BY cluster_id ORDER BY year ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {SQL_AXIS} SELECT cluster_id, CAST(year AS INTEGER) AS year, n, {r6('z')} AS z FROM zz")
def burst_scores(spark, sf_dir):
    return rounded(topics.burst_scores(topics.yearly_series(priority_series(spark, sf_dir))), "z")


SQL_PHASE = f"""{SQL_AXIS}, ar AS (SELECT cluster_id, list(CAST(n AS DOUBLE) ORDER BY year) AS c FROM sr GROUP BY ALL),
ph AS (SELECT cluster_id, (c[-1] - c[-3]) / 2 AS slope, coalesce(list_avg(c[1:len(c) - 3]), 0) AS baseline, list_sum(c[-3:]) / 3 AS recent FROM ar)"""


@query(f"""WITH {SQL_PHASE} SELECT cluster_id, {r6('slope')} AS slope, {r6('baseline')} AS baseline,
CASE WHEN baseline < 1 AND recent >= 1 AND slope >= 0 THEN 'emerging' WHEN slope > 0.75 THEN 'accelerating' WHEN slope < -0.75 THEN 'fading' WHEN recent > 0 THEN 'mature' ELSE 'unknown' END AS phase FROM ph""")
def topic_phases(spark, sf_dir):
    return rounded(topics.phases(topics.yearly_series(priority_series(spark, sf_dir))), "slope", "baseline")


@query(f"""WITH {SQL_PHASE}, s AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS total, CAST(arg_min(year, -n * 10000 + year) AS INTEGER) AS peak_year, count(*) FILTER (z >= 1) AS bursts, max(z) AS mz FROM zz GROUP BY ALL)
SELECT cluster_id, total, peak_year, bursts, {r6('mz')} AS max_z, {r6('slope')} AS slope FROM s JOIN ph USING (cluster_id)""")
def topic_lifecycle(spark, sf_dir):
    return rounded(topics.lifecycle(priority_series(spark, sf_dir), burst=1.0).drop("baseline", "phase"), "max_z", "slope")


@query(f"""WITH {SQL_AXIS}, g AS (SELECT *, n - lag(n) OVER w AS growth, row_number() OVER w - 1 AS i FROM zz WINDOW w AS (PARTITION BY cluster_id ORDER BY year)),
h AS (SELECT *, lag(growth) OVER (PARTITION BY cluster_id ORDER BY year) AS b FROM g)
SELECT cluster_id, CAST(year AS INTEGER) AS year FROM h WHERE i >= 2 AND (abs(z) >= 1.2 OR coalesce(sign(growth) <> sign(b) AND growth <> 0 AND b <> 0, false))""")
def changepoints(spark, sf_dir):
    return topics.changepoints(topics.yearly_series(priority_series(spark, sf_dir)), threshold=1.2, min_gap=1)


@query(f"""WITH {SQL_PAPERS}, pp AS (SELECT cluster_id, year FROM papers WHERE (paper_id * 7) % 3 = 0), ct AS (SELECT cluster_id, year, count(*) AS n FROM pp GROUP BY ALL),
ax AS (SELECT cluster_id, unnest(range(min(year), max(year) + 1)) AS year FROM ct GROUP BY cluster_id),
sr AS (SELECT cluster_id, year, coalesce(n, 0) AS n FROM ax LEFT JOIN ct USING (cluster_id, year)), l AS (SELECT *, lag(n) OVER (PARTITION BY cluster_id ORDER BY year) AS b FROM sr)
SELECT cluster_id, CAST(year AS INTEGER) AS year, n, coalesce(CASE WHEN b = 0 THEN n >= 2 ELSE n >= 2 * b END, false) AS burst, coalesce(b > 0 AND n <= b // 2, false) AS decay FROM l""")
def topic_evolution(spark, sf_dir):
    return topics.topic_evolution(papers(spark, sf_dir).where("(paper_id * 7) % 3 = 0"))


TAGS = ["der", "que", "the", "une"]
SQL_MENTIONS = f"{SQL_TEXTS}, mn AS (SELECT tag, year, count(*) AS n FROM texts, (SELECT unnest({TAGS}) AS tag) WHERE contains(lower(summary), tag) GROUP BY ALL)"


@query(f"WITH {SQL_MENTIONS} SELECT tag, year, n FROM mn")
def method_mentions(spark, sf_dir):
    return topics.method_mentions(texts(spark, sf_dir), TAGS, ["summary"])


@query(f"""WITH {SQL_MENTIONS}, ax AS (SELECT tag, unnest(range((SELECT min(year) FROM mn), (SELECT max(year) FROM mn) + 1)) AS year FROM (SELECT DISTINCT tag FROM mn)),
tt AS (SELECT tag, year, sum(coalesce(n, 0)) OVER (PARTITION BY tag ORDER BY year) AS t FROM ax LEFT JOIN mn USING (tag, year)),
pr AS (SELECT x.tag AS a, y.tag AS b, x.year, sign(x.t - y.t) AS s FROM tt x JOIN tt y ON x.year = y.year AND x.tag < y.tag WHERE x.t <> y.t),
ps AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY year) AS p FROM pr)
SELECT a, b, CAST(year AS INTEGER) AS crossing_year, CASE WHEN s > 0 THEN a ELSE b END AS leader FROM ps WHERE s <> p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY year) = 1""")
def method_takeovers(spark, sf_dir):
    return topics.method_takeovers(topics.method_mentions(texts(spark, sf_dir), TAGS, ["summary"]))


@query(f"""WITH {SQL_PAPERS}, {SQL_EVENTS}, rd AS (SELECT cluster_id, year(min(ts)) - any_value(year) AS lag FROM papers JOIN log USING (paper_id) GROUP BY paper_id, cluster_id),
s AS (SELECT cluster_id, avg(lag) AS m, median(lag) AS d, count(*) AS n FROM rd GROUP BY ALL)
SELECT cluster_id, {r6('m')} AS mean_lag, CAST(d AS DOUBLE) AS median_lag, n, CASE WHEN d <= 1 THEN 'real-time' WHEN d >= 2 THEN 'late' ELSE 'between' END AS kind FROM s""")
def reading_lag(spark, sf_dir):
    first = events(spark, sf_dir).groupBy("paper_id").agg(F.year(F.min("ts")).alias("read_year"))
    return rounded(topics.reading_lag(papers(spark, sf_dir).join(first, "paper_id").select("cluster_id", F.col("year").alias("pub_year"), "read_year")), "mean_lag")


@query(f"""WITH {SQL_PAPERS}, p AS (SELECT year FROM papers WHERE year NOT IN (2003, 2011)), c AS (SELECT year, count(*) AS n FROM p GROUP BY ALL)
SELECT CAST(a.year AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS year) a LEFT JOIN c USING (year)""")
def year_histogram(spark, sf_dir):
    return topics.year_histogram(papers(spark, sf_dir).where("year NOT IN (2003, 2011)"), 2030)


@query(f"WITH {SQL_PAPERS} SELECT cluster_id, {r6('avg(year)')} AS mean_year FROM papers GROUP BY ALL")
def mean_year(spark, sf_dir):
    return rounded(topics.mean_year(papers(spark, sf_dir)), "mean_year")


@query(f"WITH {SQL_PAPERS}, e AS (SELECT year, unnest(embedding[1:8]) AS x, unnest(range(0, 8)) AS factor FROM papers) SELECT year, CAST(factor AS INTEGER) AS factor, {r6('avg(x)')} AS exposure FROM e GROUP BY ALL")
def factor_exposure_by_year(spark, sf_dir):
    p = papers(spark, sf_dir).select("year", F.slice(V.as_double(F.col("embedding")), 1, 8).alias("loadings"))
    return rounded(topics.factor_exposure(p), "exposure")


@query(f"""WITH {SQL_PAPERS}, {SQL_EVENTS}, f AS (SELECT paper_id, year(min(ts)) AS y FROM log GROUP BY ALL),
e AS (SELECT coalesce(y, year) AS read_year, unnest(embedding[1:8]) AS x, unnest(range(0, 8)) AS factor FROM papers LEFT JOIN f USING (paper_id))
SELECT CAST(read_year AS INTEGER) AS read_year, CAST(factor AS INTEGER) AS factor, {r6('avg(x)')} AS exposure FROM e GROUP BY ALL""")
def factor_exposure_by_read_year(spark, sf_dir):
    p = papers(spark, sf_dir)
    j = p.join(topics.read_years(p, events(spark, sf_dir)), "paper_id").select("read_year", F.slice(V.as_double(F.col("embedding")), 1, 8).alias("loadings"))
    return rounded(topics.factor_exposure(j, "read_year"), "exposure")


@query(f"WITH {SQL_PAPERS}, e AS (SELECT paper_id, unnest(embedding[1:8]) AS x, unnest(range(0, 8)) AS factor FROM papers) SELECT paper_id, CAST(factor AS INTEGER) AS factor, {r6('x')} AS x, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY abs(x) DESC, factor) AS INTEGER) AS rank FROM e QUALIFY rank <= 3")
def strongest_factors(spark, sf_dir):
    p = papers(spark, sf_dir).select("paper_id", F.slice(V.as_double(F.col("embedding")), 1, 8).alias("loadings"))
    return rounded(topics.strongest_factors(p), "x")


@query(f"""WITH {SQL_TEXTS}, t AS (SELECT paper_id, list_distinct(regexp_extract_all(lower(title), '[a-z]{{2}}')) AS tags FROM texts), n AS (SELECT count(DISTINCT paper_id) AS n FROM t),
o AS (SELECT paper_id, unnest(tags) AS tag FROM t), sh AS (SELECT tag, (count(*) + 1) / (any_value(n.n) + 2) AS p FROM o, n GROUP BY tag),
pr AS (SELECT a.paper_id, a.tag AS a, b.tag AS b FROM o a JOIN o b USING (paper_id) WHERE a.tag < b.tag), jt AS (SELECT a, b, (count(*) + 1) / (any_value(n.n) + 2) AS pp FROM pr, n GROUP BY ALL),
tg AS (SELECT paper_id, avg(pp) AS m FROM pr JOIN jt USING (a, b) GROUP BY ALL), al AS (SELECT paper_id, exp(sum(ln(p))) AS q FROM o JOIN sh USING (tag) GROUP BY ALL)
SELECT paper_id, {r6('CASE WHEN q IS NULL THEN 0 ELSE -ln((coalesce(m, q) + 1e-9) / (q + 1e-9)) END')} AS combinational_novelty FROM t LEFT JOIN al USING (paper_id) LEFT JOIN tg USING (paper_id)""")
def combinational_novelty(spark, sf_dir):
    t = texts(spark, sf_dir).select("paper_id", F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{2}"), 0).alias("tags"))
    return rounded(novelty.combinational_novelty(t), "combinational_novelty")


@query(f"""WITH {SQL_PAPERS}, {SQL_CENTROID}, s AS (SELECT a.paper_id AS src, b.paper_id AS dst, list_cosine_similarity(a.embedding, b.embedding) AS c FROM papers a JOIN papers b ON a.cluster_id = b.cluster_id AND a.paper_id <> b.paper_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS k FROM s), t AS (SELECT src, avg((c + 1) / 2) AS sat FROM r WHERE k <= 3 GROUP BY ALL)
SELECT paper_id, {r6('1 - (list_cosine_similarity(embedding, m) + 1) / 2')} AS novelty, {r6('coalesce(sat, 0)')} AS saturation FROM papers JOIN cm USING (cluster_id) LEFT JOIN t ON src = paper_id""")
def novelty_saturation(spark, sf_dir):
    p = papers(spark, sf_dir)
    same = F.when(F.col("cluster_id").isNotNull(), F.concat_ws(" ", F.col("cluster_id").cast("string"), F.size("embedding").cast("string")))  # vectors of other dimensions have no cosine
    near = knn.knn(p, 3, same)
    return rounded(novelty.novelty_saturation(p, near).select("paper_id", "novelty", "saturation"), "novelty", "saturation")


@query(f"""WITH {SQL_PAPERS}, c AS (SELECT unnest([2005, 2010, 2015]) AS cutoff)
SELECT CAST(cutoff AS INTEGER) AS cutoff, count(*) FILTER (year >= cutoff) AS n, {r6('coalesce(avg(embedding[1]) FILTER (year >= cutoff), 0)')} AS mean_degree FROM papers, c GROUP BY ALL""")
def counterfactuals(spark, sf_dir):
    p = papers(spark, sf_dir)
    return rounded(topics.counterfactuals(p, p.select("paper_id", F.col("embedding")[0].cast("double").alias("degree")), (2005, 2010, 2015)), "mean_degree")
