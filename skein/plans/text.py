"""Text, claim, citation and hygiene queries over documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import python as P
from skein.functions import text as T
from skein.operators import citations, claims, entities, hygiene, knn, recommend
from skein.plans.recursive import pagerank_sql
from skein.plans.registry import query, r6, rounded
from skein.plans.vectors import SQL_KNN
from skein.sources.adapters import SQL_TEXTS, papers, read, texts

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"


def sql_any(c: str, cues) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{x}')" for x in cues) + ")"


def sql_sentences(c: str) -> str:
    # sentence ends become a mark, since the engine has no look-behind
    return f"list_filter(string_split(regexp_replace(trim({c}, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)"


@query(f"WITH {SQL_TEXTS} SELECT paper_id, len({sql_tokens('summary')}) AS n_tokens, len(list_distinct({sql_tokens('summary')})) AS n_distinct FROM texts")
def token_counts(spark, sf_dir):
    t = texts(spark, sf_dir)
    return t.select("paper_id", F.size(T.tokens(F.col("summary"))).alias("n_tokens"), F.size(T.token_set(F.col("summary"))).alias("n_distinct"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({sql_tokens('text')}) AS s FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) AS i, len(list_distinct(list_concat(a.s, b.s))) AS u, len(a.s) AS x, len(b.s) AS y FROM b a JOIN b b ON a.item_id < b.item_id)
SELECT a, b, {r6('CASE WHEN x > 0 AND y > 0 THEN i / u ELSE 0 END')} AS jaccard FROM p""")
def token_jaccard(spark, sf_dir):
    s = read(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("s"))
    a, b = s.select(F.col("item_id").alias("a"), F.col("s").alias("x")), s.select(F.col("item_id").alias("b"), F.col("s").alias("y"))
    return rounded(a.join(b, F.col("a") < F.col("b")).select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("jaccard")), "jaccard")


@query(f"""WITH {SQL_TEXTS}, w AS (SELECT paper_id, unnest(list_filter(regexp_split_to_array(lower(summary), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS word FROM texts), n AS (SELECT paper_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT paper_id, word, n, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM n QUALIFY rank <= 12""")
def keywords(spark, sf_dir):
    from pyspark.sql import Window

    w = texts(spark, sf_dir).select("paper_id", F.explode(F.filter(F.split(F.lower("summary"), "[^a-z0-9]+"), lambda x: F.length(x) > 3)).alias("word"))
    n = w.groupBy("paper_id", "word").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "word"))).where("rank <= 12")


@query(f"""WITH {SQL_TEXTS}, w AS (SELECT topic, unnest({sql_tokens('summary')}) AS word FROM texts), n AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS k FROM n)
SELECT topic, string_agg(word, ',' ORDER BY k) AS keywords FROM r WHERE k <= 4 GROUP BY ALL""")
def cluster_keywords(spark, sf_dir):
    return recommend.cluster_keywords(texts(spark, sf_dir), "topic", T.tokens(F.col("summary"))).select("topic", "keywords")


def _chunk_end(s: str) -> str:
    """Where a chunk that starts at s ends: after the last white space of its final 120 characters, if there is one and text is left."""
    tail = f"length(regexp_extract(substr(text, {s} + 1681, 120), '(?s)^.*\\s'))"
    return f"CASE WHEN {s} + 1800 >= n THEN n WHEN {tail} > 0 THEN {s} + 1679 + {tail} ELSE {s} + 1800 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS paper_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT paper_id, text, n, 0 AS ord, CAST(0 AS BIGINT) AS s, {_chunk_end('0')} AS e FROM d UNION ALL SELECT paper_id, text, n, ord + 1, greatest(s + 1, e - 200), {_chunk_end('greatest(s + 1, e - 200)')} FROM c WHERE e < n AND ord < 19)
SELECT paper_id, ord, substr(text, s + 1, e - s) AS text FROM c""")
def sliding_chunks(spark, sf_dir):
    return texts(spark, sf_dir).select("paper_id", F.posexplode(P.chunks()("summary")).alias("ord", "text"))


@query(f"""WITH t AS (SELECT page_id, html FROM pages), u AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)https?://[^\\s)}}\\]]+'), lambda x: regexp_replace(x, '[).,;\\]}}]+$', '')) AS u FROM t)
SELECT page_id, len(list_distinct(u)) AS n_urls, coalesce(u[1], '') AS first_url FROM u""")
def page_urls(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select("page_id", T.urls(F.col("html")).alias("u"))
    return u.select("page_id", F.size("u").alias("n_urls"), F.coalesce(F.try_element_at("u", F.lit(1)), F.lit("")).alias("first_url"))


@query(f"""SELECT page_id, {sql_any('html', T.CODE_CUES)} AS code, round(least(1, 0.18 * least(1, len(regexp_extract_all(lower(html), 'ablation')) / 2) + 0.16 * least(1, len(regexp_extract_all(lower(html), 'baseline')) / 3)
 + 0.10 * {sql_any('html', T.STATISTICS)}::INT + 0.10 * {sql_any('html', T.INTERVALS)}::INT + 0.08 * contains(lower(html), 'limitation')::INT
 + 0.10 * least(1, len(regexp_extract_all(lower(html), '\\bfig(?:ure)?\\s*\\d+\\b')) / 6) + 0.08 * least(1, len(regexp_extract_all(lower(html), '\\btable\\s*\\d+\\b')) / 4)), 6) + 0.0 AS rigor FROM pages""")
def rigor_proxy(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.has_any(F.col("html"), T.CODE_CUES).alias("code"), F.round(T.rigor(F.col("html"), F.lit(0.0)), 6).alias("rigor"))


@query(f"WITH {SQL_TEXTS} SELECT paper_id, CASE WHEN {sql_any('summary', T.NEGATIVE)} THEN -1 ELSE 1 END AS sign FROM texts")
def claim_sign(spark, sf_dir):
    return texts(spark, sf_dir).select("paper_id", T.claim_sign(F.col("summary")).alias("sign"))


SQL_BENCH = "bt AS (SELECT item_id AS id, text FROM benchmark)"
SQL_TFIDF = f"""{SQL_BENCH}, w AS (SELECT id, regexp_extract_all(lower(text), '[\\w\\x{{00C0}}-\\x{{017F}}]{{2,}}') AS w FROM bt),
tm AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM tm GROUP BY ALL),
kp AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL ORDER BY total DESC, term LIMIT 1200),
wt AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM bt)) / (1 + df)) + 1) AS w FROM tf JOIN kp USING (term)), wn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM wt)"""


def _bench(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    shared = lambda word, n, times: F.repeat(F.concat(F.lit(f" {word}"), (F.col("item_id") % n).cast("string")), times)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(ascii_only, shared("theme", 9, 6), shared("topic", 5, 4), F.lit(" in common")).alias("text"))


SQL_TFIDF = SQL_TFIDF.replace(SQL_BENCH, "bt AS (SELECT item_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') || repeat(' theme' || (item_id % 9), 6) || repeat(' topic' || (item_id % 5), 4) || ' in common' AS text FROM benchmark)").replace("[\\w\\x{00C0}-\\x{017F}]{2,}", "\\w\\w+")


@query(f"WITH {SQL_TFIDF} SELECT id, term, {r6('weight')} AS weight FROM wn")
def tfidf(spark, sf_dir):
    return rounded(claims.tfidf(_bench(spark, sf_dir), "id", "text", 1_200), "weight")


SQL_CLAIMS = f"""{SQL_TEXTS}, cs AS (SELECT paper_id, topic AS cluster_id, year, {sql_sentences('summary')} AS s FROM texts),
cf AS (SELECT paper_id, cluster_id, year, list_filter(s, lambda x: {sql_any('x', T.CLAIM_STEMS)}) AS st, s FROM cs),
ce AS (SELECT paper_id, cluster_id, year, CASE WHEN len(st) > 0 THEN st ELSE s[1:1] END AS c, CASE WHEN len(st) > 0 THEN 0.6 ELSE 0.4 END AS strength FROM cf),
cl AS (SELECT paper_id, cluster_id, year, strength, unnest(range(0, len(c))) AS i, unnest(c) AS statement FROM ce),
claims AS (SELECT paper_id || '#' || i AS claim_id, paper_id, cluster_id, year, statement, strength, CASE WHEN {sql_any('statement', T.NEGATIVE)} THEN -1 ELSE 1 END AS sign FROM cl)"""


def _claims(spark, sf_dir):
    return claims.extract_claims(texts(spark, sf_dir).withColumnRenamed("topic", "cluster_id"))


@query(f"WITH {SQL_CLAIMS} SELECT claim_id, paper_id, CAST(strength AS DOUBLE) AS strength, sign, trim(statement, ' ') AS statement FROM claims")
def extracted_claims(spark, sf_dir):
    return _claims(spark, sf_dir).select("claim_id", "paper_id", "strength", "sign", "statement")


def _bench_claims(spark, sf_dir):
    b = _bench(spark, sf_dir)
    return b.select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("claim_id"), (F.col("id") % 7).alias("paper_id"), (F.col("id") % 3).alias("cluster_id"), (F.lit(2000) + F.col("id") % 5).cast("int").alias("year"), F.col("text").alias("statement"), F.when(F.col("id") % 4 == 0, -1).otherwise(1).alias("sign"))


SQL_PAIRS = f"""{SQL_TFIDF.replace('LIMIT 1200', 'LIMIT 8000')}, bc AS (SELECT id, 'c' || lpad(CAST(id AS VARCHAR), 4, '0') AS claim_id, id % 7 AS paper_id, id % 3 AS cluster_id, CAST(2000 + id % 5 AS INTEGER) AS year, CASE WHEN id % 4 = 0 THEN -1 ELSE 1 END AS sign FROM bt),
cp AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS c FROM wn x JOIN wn y ON x.term = y.term AND x.id < y.id GROUP BY ALL)"""


@query(f"""WITH {SQL_PAIRS}, p AS (SELECT a.claim_id AS ca, b.claim_id AS cb, a.year AS ya, b.year AS yb, a.sign AS sa, b.sign AS sb, c FROM cp JOIN bc a ON a.id = cp.a JOIN bc b ON b.id = cp.b WHERE c >= 0.18 AND a.year <> b.year)
SELECT CASE WHEN yb > ya THEN ca ELSE cb END AS src, CASE WHEN yb > ya THEN cb ELSE ca END AS dst, {r6('c * exp(-0.15 * abs(yb - ya))')} AS weight, CASE WHEN yb > ya THEN sb ELSE sa END AS sign, least(ya, yb) AS from_year, greatest(ya, yb) AS to_year FROM p""")
def influence_edges(spark, sf_dir):
    return rounded(claims.influence_edges(_bench_claims(spark, sf_dir)), "weight")


@query(f"""WITH {SQL_PAIRS}, base AS (SELECT cluster_id, count(*) AS claims, count(DISTINCT paper_id) AS papers FROM bc GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT a.cluster_id, count(*) FILTER (a.sign = b.sign) AS s, count(*) FILTER (a.sign <> b.sign) AS c FROM cp JOIN bc a ON a.id = cp.a JOIN bc b ON b.id = cp.b AND a.cluster_id = b.cluster_id JOIN base ON base.cluster_id = a.cluster_id WHERE cp.c >= CASE WHEN claims < 120 THEN 0.22 ELSE 0.28 END GROUP BY ALL)
SELECT cluster_id, claims, papers, coalesce(s, 0) AS supports, coalesce(c, 0) AS contradicts, {r6('coalesce(c, 0) / (coalesce(s, 0) + coalesce(c, 0) + 1e-6)')} AS controversy_rate, {r6('(coalesce(s, 0) - coalesce(c, 0)) / (coalesce(s, 0) + coalesce(c, 0) + 1e-6)')} AS consensus, {r6('claims / greatest(papers, 1)')} AS diversity FROM base LEFT JOIN p USING (cluster_id)""")
def claim_controversy(spark, sf_dir):
    return rounded(claims.controversy(_bench_claims(spark, sf_dir)), "controversy_rate", "consensus", "diversity")


@query(f"""WITH RECURSIVE {SQL_PAIRS}, mp AS MATERIALIZED (SELECT a.claim_id AS a, b.claim_id AS b, c FROM cp JOIN bc a ON a.id = cp.a JOIN bc b ON b.id = cp.b AND a.cluster_id = b.cluster_id WHERE c >= 0.22), mb AS (SELECT a, b, c FROM mp UNION ALL SELECT b, a, c FROM mp),
reach(node, other) AS (SELECT claim_id, claim_id FROM bc UNION SELECT reach.node, mb.b FROM reach JOIN mb ON reach.other = mb.a), co AS (SELECT node AS claim_id, min(other) AS component FROM reach GROUP BY node),
rs AS (SELECT a AS claim_id, sum(c) AS row_sum FROM mb GROUP BY a), al AS (SELECT bc.*, component, coalesce(round(row_sum, 9), 0) AS row_sum FROM bc JOIN co USING (claim_id) LEFT JOIN rs USING (claim_id)), tp AS (SELECT cluster_id, count(DISTINCT paper_id) AS cluster_papers FROM bc GROUP BY ALL),
g AS (SELECT cluster_id, component, count(*) AS size, count(DISTINCT paper_id) AS papers, count(*) FILTER (sign > 0) AS positive, arg_max(claim_id, (row_sum, claim_id)) AS representative FROM al GROUP BY ALL)
SELECT cluster_id, component, size, papers, positive, representative, {r6('greatest(positive, size - positive) / size * papers / greatest(cluster_papers, 1) * CASE WHEN positive > 0 AND positive < size THEN 0.5 ELSE 1 END')} AS maturity FROM g JOIN tp USING (cluster_id)""")
def claim_maturity(spark, sf_dir):
    return rounded(claims.maturity(_bench_claims(spark, sf_dir)), "maturity")


SQL_INFLUENCE = f"""{SQL_PAIRS}, ip AS (SELECT a.claim_id AS ca, b.claim_id AS cb, a.year AS ya, b.year AS yb, a.sign AS sa, b.sign AS sb, c FROM cp JOIN bc a ON a.id = cp.a JOIN bc b ON b.id = cp.b WHERE c >= 0.18 AND a.year <> b.year),
ie AS MATERIALIZED (SELECT CASE WHEN yb > ya THEN ca ELSE cb END AS src, CASE WHEN yb > ya THEN cb ELSE ca END AS dst, c * exp(-0.15 * abs(yb - ya)) AS weight, CASE WHEN yb > ya THEN sb ELSE sa END AS sign FROM ip), pe AS (SELECT * FROM ie WHERE sign = 1), ne AS (SELECT * FROM ie WHERE sign = -1), cn AS (SELECT claim_id AS node FROM bc)"""


@query(f"""WITH {SQL_INFLUENCE}, {pagerank_sql('ie', 'cn', 60, 'x')}, {pagerank_sql('pe', 'cn', 60, 'y')}, {pagerank_sql('ne', 'cn', 60, 'z')}
SELECT x.node, round(x.r, 8) + 0.0 AS influence, round(y.r, 8) + 0.0 AS positive, round(z.r, 8) + 0.0 AS negative, {r6('coalesce(i.s, 0)')} AS in_strength, {r6('coalesce(o.s, 0)')} AS out_strength FROM xp60 x JOIN yp60 y USING (node) JOIN zp60 z USING (node)
LEFT JOIN (SELECT dst AS node, sum(weight) AS s FROM ie GROUP BY ALL) i USING (node) LEFT JOIN (SELECT src AS node, sum(weight) AS s FROM ie GROUP BY ALL) o USING (node)""")
def claim_influence(spark, sf_dir):
    c = _bench_claims(spark, sf_dir)
    return rounded(rounded(claims.influence(claims.influence_edges(c), c.select(F.col("claim_id").alias("node"))), "influence", "positive", "negative", digits=8), "in_strength", "out_strength")


@query(f"""WITH {SQL_TEXTS}, s AS (SELECT topic, unnest(list_filter({sql_sentences('summary')}, lambda x: {sql_any('x', T.GAP_CUES)})[1:3]) AS sentence FROM texts), n AS (SELECT topic, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) AS sentence, count(*) AS n FROM s GROUP BY ALL)
SELECT topic, sentence, n, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, sentence) AS INTEGER) AS rank FROM n WHERE length(sentence) >= 30 QUALIFY rank <= 8""")
def gap_sentences(spark, sf_dir):
    return claims.gap_clusters(texts(spark, sf_dir))


def _typed(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    claim = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("cluster_id"), F.concat_ws(" ", F.when(F.col("o_orderkey") % 3 == 0, "we improve").otherwise("we test"), F.when(F.col("o_orderkey") % 5 == 0, "it does not hold").when(F.col("o_orderkey") % 7 == 0, "it extends")).alias("statement"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).alias("dataset"), F.array(F.floor(F.col("o_totalprice") / 10).cast("string")).alias("metrics"))
    return claim


SQL_TYPED = """tc AS (SELECT o_orderkey AS claim_id, o_custkey AS paper_id, o_orderpriority AS cluster_id, concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'we improve' ELSE 'we test' END, CASE WHEN o_orderkey % 5 = 0 THEN 'it does not hold' WHEN o_orderkey % 7 = 0 THEN 'it extends' END) AS s, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS d, CAST(floor(o_totalprice / 10) AS BIGINT) AS m FROM orders),
rl AS (SELECT a.claim_id AS src, b.claim_id AS dst, CASE WHEN contains(a.s, 'improve') AND contains(b.s, 'does not') THEN 'contradicts' WHEN contains(b.s, 'extends') THEN 'extends' WHEN contains(a.s, 'improve') AND contains(b.s, 'improve') THEN 'supports' ELSE 'comparesTo' END AS kind,
 a.cluster_id AS ca, b.cluster_id AS cb, a.paper_id AS pa, b.paper_id AS pb FROM tc a JOIN tc b ON a.claim_id <> b.claim_id AND (a.d = b.d OR a.m = b.m))"""


@query(f"WITH {SQL_TYPED} SELECT src, dst, kind FROM rl")
def claim_relations(spark, sf_dir):
    return claims.relations(_typed(spark, sf_dir))


@query(f"WITH {SQL_TYPED} SELECT pa AS src_paper, pb AS dst_paper, kind, count(*) AS n FROM rl WHERE pa <> pb GROUP BY ALL")
def paper_relations(spark, sf_dir):
    return claims.related_papers(_typed(spark, sf_dir))


@query(f"""WITH {SQL_TYPED}, sd AS (SELECT *, ca AS cluster_id, src AS claim, pa AS paper FROM rl UNION ALL SELECT *, cb, dst, pb FROM rl)
SELECT cluster_id, count(DISTINCT (src, dst)) FILTER (ca = cb AND kind = 'supports') AS supports, count(DISTINCT (src, dst)) FILTER (ca = cb AND kind = 'contradicts') AS contradicts, count(DISTINCT (src, dst)) FILTER (ca = cb AND kind = 'comparesTo') AS compares,
count(*) FILTER (ca <> cb AND kind = 'contradicts') AS cross_contradicts, {r6('count(DISTINCT claim) / count(DISTINCT paper)')} AS diversity FROM sd GROUP BY cluster_id""")
def edge_controversy(spark, sf_dir):
    return rounded(claims.relation_controversy(_typed(spark, sf_dir)), "diversity")


@query("""WITH l AS (SELECT event_id, event_type AS assumption, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events ORDER BY event_id DESC LIMIT 5000), n AS (SELECT CAST(k % 10 AS VARCHAR) AS cluster_id, assumption, sum(k) AS weight FROM l GROUP BY ALL)
SELECT cluster_id, assumption, CAST(weight AS BIGINT) AS weight, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, assumption) AS INTEGER) AS rank FROM n QUALIFY rank <= 8""")
def stress_rollup(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("assumption"), F.to_json(F.create_map((k % 10).cast("string"), k)).alias("clusters"))
    return claims.stress_rollup(log)


@query(f"""WITH b AS (SELECT item_id AS src, list_distinct({sql_tokens('text')}) AS s FROM benchmark), d AS (SELECT doc_id AS dst, list_distinct({sql_tokens("split_part(text, chr(10), 1)")}) AS s FROM documents),
h AS (SELECT src, dst, len(list_intersect(b.s, d.s)) AS i, len(b.s) + len(d.s) AS n FROM b, d), m AS (SELECT src, dst, i / (n - i) AS score FROM h WHERE i >= 3)
SELECT src, dst, {r6('score')} AS weight FROM m WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) = 1""")
def citation_matches(spark, sf_dir):
    refs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src"), F.col("text").alias("title_guess"), F.lit(None).cast("int").alias("year_guess"))
    p = texts(spark, sf_dir).select("paper_id", "title", "year")
    return rounded(citations.match_references(refs, p, least=0.3), "weight")


@query("""WITH e AS (SELECT doc_id AS paper_id, 1 AS ord, '[1] A. B. "Study ' || doc_id || ' of long things." ' || (2000 + doc_id % 20) || '. https://x.org/' || doc_id AS entry, 'Study ' || doc_id || ' of long things.' AS title_guess FROM documents
UNION ALL SELECT doc_id, 2, '[2] C. D. Another work number ' || doc_id || '. Journal of things. ' || (1950 + doc_id % 50) || '. doi:10.1234/ab.' || doc_id || ' arXiv: 1706.0' || (1000 + doc_id % 9000), 'Another work number ' || doc_id FROM documents)
SELECT paper_id, CAST(ord AS BIGINT) AS ord, entry, nullif(regexp_extract(entry, '(?i)10[.][0-9]{4,9}/[A-Z0-9()/:;._-]+'), '') AS doi, nullif(regexp_extract(entry, 'https?://[^ )}]+'), '') AS url, nullif(regexp_extract(entry, '(?i)arxiv:\\s*[0-9]{4}[.][0-9]{4,5}'), '') AS arxiv, CAST(nullif(regexp_extract(entry, '\\b(?:19|20)[0-9]{2}\\b'), '') AS INTEGER) AS year_guess, title_guess FROM e""")
def reference_fields(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    first = F.concat(F.lit('[1] A. B. "Study '), i, F.lit(' of long things." '), (F.lit(2000) + F.col("doc_id") % 20).cast("string"), F.lit(".\nhttps://x.org/"), i)
    second = F.concat(F.lit("[2] C. D. Another work number "), i, F.lit(". Journal of things. "), (F.lit(1950) + F.col("doc_id") % 50).cast("string"), F.lit(". doi:10.1234/ab."), i, F.lit("  arXiv: 1706.0"), (F.lit(1000) + F.col("doc_id") % 9000).cast("string"))
    body = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.concat_ws("\n", "text", F.lit("References"), first, second).alias("text"))
    return citations.reference_fields(citations.reference_entries(body))


@query(f"WITH {SQL_KNN} SELECT least(src, dst) AS a, greatest(src, dst) AS b, {r6('max(score)')} AS cosine FROM kn WHERE score >= 0.4 GROUP BY ALL")
def near_pairs(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("title", F.lit("one title for all papers"))
    return rounded(hygiene.duplicate_pairs(knn.knn(p), p, cosine=0.4).select("a", "b", "cosine"), "cosine")


@query(f"""WITH RECURSIVE {SQL_KNN}, dp AS (SELECT DISTINCT src AS a, dst AS b FROM kn WHERE score >= 0.4 UNION SELECT DISTINCT dst, src FROM kn WHERE score >= 0.4), reach(node, other) AS (SELECT DISTINCT a, a FROM dp UNION SELECT reach.node, dp.b FROM reach JOIN dp ON reach.other = dp.a), co AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT component, array_to_string(list(node ORDER BY node), ',') AS members FROM co GROUP BY component""")
def duplicate_groups(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("title", F.lit("one title for all papers"))
    return hygiene.duplicate_groups(hygiene.duplicate_pairs(knn.knn(p), p, cosine=0.4)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


SQL_FLAGS = f"""WITH {SQL_TEXTS}, c AS (SELECT doc_id AS paper_id, length(text) AS l FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT t.paper_id, coalesce(c.l, 0) AS l, CAST(c.l IS NOT NULL AS BIGINT) AS n, list_filter([CASE WHEN length(trim(title)) < 5 THEN 'missing_title' END, CASE WHEN t.year IS NULL THEN 'missing_year' END, CASE WHEN c.l IS NULL THEN 'missing_chunks' END, CASE WHEN length(trim(summary)) < 60 THEN 'short_summary' END, CASE WHEN coalesce(c.l, 0) < 1200 THEN 'low_text_yield' END], lambda x: x IS NOT NULL) AS flags FROM texts t LEFT JOIN c USING (paper_id))"""


def _flags(spark, sf_dir):
    t = texts(spark, sf_dir)
    return hygiene.ingestion_flags(t, t.where("paper_id % 5 <> 0").select("paper_id", F.col("summary").alias("text")))


@query(f"""{SQL_FLAGS} SELECT paper_id, array_to_string(flags, ',') AS flags, l AS text_length, n AS chunk_count FROM f""")
def ingestion_flags(spark, sf_dir):
    return _flags(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query(f"""{SQL_FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY ALL""")
def ingestion_flag_totals(spark, sf_dir):
    return hygiene.flag_totals(_flags(spark, sf_dir))


@query("""WITH t AS (SELECT string_agg(p_name || '|v' || p_size, '||' ORDER BY p_name, p_size) AS t FROM part), RECURSIVE_FREE AS (SELECT list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS HUGEINT)) AS c FROM t)
SELECT CAST(list_reduce(list_prepend(CAST(5381 AS HUGEINT), c), lambda h, x: (h * 33 + x) % CAST(18446744073709551616 AS HUGEINT)) AS VARCHAR) AS version FROM RECURSIVE_FREE""".replace("RECURSIVE_FREE", "codes"))
def corpus_version(spark, sf_dir):
    return hygiene.corpus_version(read(spark, sf_dir, "part").select(F.col("p_name").alias("file_path"), F.col("p_size").alias("version")))


@query()
def title_similarity(spark, sf_dir):
    """Of each paper's title and the next one's; the sequence ratio has no SQL."""
    t = texts(spark, sf_dir).select("paper_id", "title")
    a, b = t.select(F.col("paper_id").alias("a"), F.col("title").alias("x")), t.select(F.col("paper_id").alias("b"), F.col("title").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", hygiene.title_similarity(F.col("x"), F.col("y")).alias("similarity"))


@query("""SELECT doc_id AS paper_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(substr(f, 1, 79)) || '…' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""")
def clipped_text(spark, sf_dir):
    return texts(spark, sf_dir).select("paper_id", T.clip(F.col("summary"), 80).alias("clipped"))


SQL_CAPS = "SELECT doc_id AS paper_id, unnest(list_distinct(list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{2,}')))) AS name FROM documents"


@query(SQL_CAPS)
def acronyms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(entities.acronyms(F.col("text"))).alias("e")).select("paper_id", "e.name")


SQL_ENTITIES = f"""{SQL_TEXTS}, caps AS ({SQL_CAPS}), mt AS (SELECT paper_id, 'metric' AS kind, CASE WHEN m IN ('auc', 'auroc', 'bleu') THEN upper(m) ELSE m END AS name, (length(lower(summary)) - length(replace(lower(summary), m, ''))) // length(m) AS n FROM texts, (SELECT unnest({list(T.METRICS)}) AS m)),
nm AS (SELECT paper_id, name, summary, strpos(summary, name) AS pos, (length(summary) - length(replace(summary, name, ''))) // length(name) AS n FROM caps JOIN texts USING (paper_id)),
en AS (SELECT * FROM mt WHERE n > 0 UNION ALL SELECT paper_id, CASE WHEN {sql_any('substr(summary, greatest(pos - 60, 1), length(name) + 120)', entities.DATASET_CUES)} THEN 'dataset' ELSE 'method' END, name, n FROM nm),
found AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY paper_id, kind ORDER BY n DESC, name) <= 6)"""


@query(f"WITH {SQL_ENTITIES} SELECT * FROM found")
def named_entities(spark, sf_dir):
    return entities.entities(texts(spark, sf_dir).select("paper_id", F.col("summary").alias("text")))


@query(f"""WITH {SQL_ENTITIES}, best AS (SELECT kind, name FROM found GROUP BY kind, name QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(DISTINCT paper_id) DESC, name) <= 40)
SELECT kind, name, year, count(DISTINCT paper_id) AS n FROM found JOIN best USING (kind, name) JOIN texts USING (paper_id) GROUP BY ALL""")
def entity_adoption(spark, sf_dir):
    d = texts(spark, sf_dir)
    return entities.adoption(entities.entities(d.select("paper_id", F.col("summary").alias("text"))), d)


@query("""WITH l AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM l WHERE used <= 2000""")
def context_budget(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    return entities.context(c, 2_000, "conv_id").select("conv_id", F.col("ord").alias("turn"), "used")


@query("SELECT conv_id, turn, array_to_string(list_filter(['the', 'ing', 'que'], lambda k: NOT contains(lower(text), k)), ',') AS missing FROM conversations")
def missing_points(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", entities.missing_points(F.col("text"), F.array(F.lit("the"), F.lit("ing")), F.array(F.lit("que"))).alias("missing")).withColumn("missing", F.array_join("missing", ","))


@query("""WITH t AS (SELECT conv_id AS id, turn, role = 'user' AS q, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations), o AS (SELECT *, sum(q::INT) OVER (PARTITION BY id ORDER BY turn) AS ord FROM t)
SELECT id, CAST(ord AS BIGINT) AS ord, arg_min(body, turn) FILTER (q) AS question, arg_min(body, turn) FILTER (NOT q) AS answer FROM o WHERE ord > 0 GROUP BY ALL HAVING count(*) FILTER (q) > 0 AND count(*) FILTER (NOT q) > 0""")
def flashcards(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.concat(F.when(s["role"] == "user", "Q: ").otherwise("A: "), T.collapse(s["text"]))), "\n").alias("text"))
    return entities.flashcards(c)
