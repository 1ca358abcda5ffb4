"""Connected components of an edge table, without collecting it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the least node it is linked to.

    Each round takes the least label among neighbours, then the label of the label
    (pointer jumping), so the rounds grow with the logarithm of a component's width. Each
    round is a written table in the shared folder, so a lost executor loses nothing.
    """
    real = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # turned round row by row, so that what the edges come from is computed once
    both = materialise(real.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = materialise(least.join(jump, "via").select("node", F.least("via", "far").alias("label"), (F.least("via", "far") < F.col("old")).alias("changed")))
    return labels.select("node", F.col("label").alias("component"))
