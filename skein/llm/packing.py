"""Operator 8, packing into length buckets that waste the fewest padding tokens.

The histogram of token counts over all documents is the only thing that reaches the
driver; it has one row per distinct length. Dynamic programming over it picks at most
`buckets` upper bounds such that padding every document to its bucket's bound adds the
fewest tokens (divide and conquer: the best cut moves monotonically). Inside a bucket,
documents in order of doc_id fill batches of max(1, budget / bound) documents each.

The position in a bucket is exact and never sorts a bucket in one task, whatever the ids
are: documents are divided into ranges of (bucket, doc_id, n_tokens) of about equal size,
counted by range, and the counts summed up to offsets; only documents of one range and
bucket are ranked together.

Defined results: tokens are runs of characters other than white space; null and texts
without tokens have 0 tokens and no bucket or batch (null); a document longer than the
budget is a batch of its own; null ids come first; equal ids are ordered by length;
among equally good bounds the smallest are taken.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialise
from skein.sources.storage import spread

BUCKETS = 16
BUDGET = 32_768
RANGE_ROWS = 1 << 20


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets; lengths are distinct and ascending."""
    m = len(lengths)
    k = min(buckets, m)
    if not k:
        return []
    size = np.concatenate(([0], np.asarray(lengths, np.int64)))
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    s = np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64) * np.asarray(counts, np.int64))))
    worst = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, worst)
    best[0] = 0
    cuts = []
    for layer in range(1, k + 1):
        new, cut = np.full(m + 1, worst), np.zeros(m + 1, np.int64)
        base = best + s  # cost(i, j) = size[j] * (c[j] - c[i]) - (s[j] - s[i])
        todo = [(layer, m, layer - 1, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(b, j - 1)
            cost = base[a: end + 1] - size[j] * c[a: end + 1]
            i = a + int(cost.argmin())
            new[j], cut[j] = cost[i - a] + size[j] * c[j] - s[j], i
            todo += [(lo, j - 1, a, i), (j + 1, hi, i, b)]
        best = new
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        bounds.append(int(size[j]))
        j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (its bound), batch (0, 1, ... in the bucket) for every row."""
    docs = spread(docs)
    count = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(r"\S+")), F.lit(0))
    sized = materialise(docs.select(docs["doc_id"].cast("long").alias("doc_id"), count.cast("long").alias("n_tokens")))
    histogram = sized.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    bounds = optimal_bounds(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), buckets)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    order = [F.col("bucket"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens")]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(histogram["count"].sum()) // RANGE_ROWS))
    full = sized.where("n_tokens > 0").withColumn("bucket", bucket)
    # written, since a range must stay what it was when its rows were counted
    placed = materialise(full.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "range").agg(F.count("*").alias("n")).select("bucket", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "range").orderBy(*order[1:])
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "range"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    none = F.lit(None).cast("long")
    rest = sized.where("n_tokens = 0").select("doc_id", "n_tokens", none.alias("bucket"), none.alias("batch"))
    return ranked.select("doc_id", "n_tokens", "bucket", F.floor((F.col("start") + F.col("rank")) / capacity).alias("batch")).unionByName(rest)


def oracle_sql(buckets: int = BUCKETS, budget: int = BUDGET, source: str = "documents") -> str:
    """The same packing in DuckDB, one table expression for each bucket of the optimum."""
    layers = ["l1 AS (SELECT j, [len] AS bounds, len * c - s AS cost FROM h)"]
    for k in range(2, buckets + 1):
        layers.append(f"""l{k} AS (SELECT h.j, arg_min(list_append(p.bounds, h.len), (p.cost + h.len * (h.c - q.c) - (h.s - q.s)) * 1000000 + p.j) AS bounds,
  min(p.cost + h.len * (h.c - q.c) - (h.s - q.s)) AS cost FROM h JOIN l{k - 1} p ON p.j < h.j JOIN h q ON q.j = p.j GROUP BY h.j)""")
    last = " UNION ALL ".join(f"SELECT {k} AS k, bounds FROM l{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    return f"""WITH sized AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 0) AS BIGINT) AS n_tokens FROM {source}),
g AS (SELECT n_tokens AS len, count(*) AS n FROM sized WHERE n_tokens > 0 GROUP BY 1),
h AS (SELECT len, row_number() OVER (ORDER BY len) AS j, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS c, CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS s FROM g),
{', '.join(layers)},
best AS (SELECT unnest(bounds) AS bucket FROM (SELECT bounds FROM ({last}) ORDER BY k DESC LIMIT 1)),
placed AS (SELECT doc_id, n_tokens, (SELECT min(bucket) FROM best WHERE bucket >= n_tokens AND n_tokens > 0) AS bucket FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS r FROM placed)
SELECT doc_id, n_tokens, bucket, CASE WHEN bucket IS NOT NULL THEN CAST(r // greatest(1, {budget} // bucket) AS BIGINT) END AS batch FROM ranked"""
