"""Vector arithmetic on array columns, in double precision."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with value computed once for the row, however often a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null where the dimensions differ."""
    product = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero, null where the dimensions differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


def squared_distance(a: Column, b: Column) -> Column:
    """Infinite where the dimensions differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(float("inf")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scale(v: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(as_double(v), lambda x: x * k))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    return let(as_double(v), lambda a: let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, x).otherwise(x / F.nullif(n, F.lit(0.0))))))


def fit_dimension(v: Column, dim: int) -> Column:
    """Truncated or padded with zeros."""
    return F.slice(F.concat(as_double(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def mean_vectors(df, keys: list[str], column: str = "embedding", weight: Column | None = None, out: str = "centroid"):
    """The (weighted) mean vector of each group, by element; other dimensions than the first id's are ignored.

    Aggregates elements, not arrays, so partial sums combine before the shuffle.
    """
    w = F.lit(1.0) if weight is None else weight
    sized = df.select(*keys, as_double(F.col(column)).alias("_v"), w.cast("double").alias("_w")).where("_v IS NOT NULL")
    each = sized.select(*keys, "_w", F.posexplode("_v").alias("_i", "_x"))
    sums = each.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))
