"""Dense vectors between Arrow and numpy."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """((vec_id, v), dim): one usable vector, as float32 bytes, for each id.

    Left out: null ids, null or empty vectors, vectors with a null, NaN or infinite element,
    of another dimension than most, or of norm 0. Of rows with one id the least vector stays.
    """
    spark = table.sparkSession
    raw = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    if dim is None:
        top = raw.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if top is None:
            return spark.createDataFrame([], "vec_id long, v binary"), 0
        dim = top["d"]

    def run(batches):
        for b in batches:
            column = b.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in x[good].astype(np.float32)], pa.binary())], names=["vec_id", "v"])

    fine = raw.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda e: e.isNull()))
    return fine.mapInArrow(run, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v")), dim


def matrix(column, dim: int) -> np.ndarray:
    """The rows of a binary column (Arrow or pandas) as they are stored, in float64."""
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dim).astype(np.float64)


def units(column, dim: int) -> np.ndarray:
    """The rows scaled to length 1, in float32, for searching."""
    x = matrix(column, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, in float64."""
    return np.clip((x * y).sum(-1) / np.sqrt((x * x).sum(-1) * (y * y).sum(-1)), -1.0, 1.0)


def sample(vectors: DataFrame, rows: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of at most `rows` vectors, those with the smallest hash of their id."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toPandas()
    return got["vec_id"].to_numpy(np.int64), units(got["v"], dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros(c.shape, np.float64)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(counts == 0)
        c = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
        if len(empty):
            far = np.argsort(-d[np.arange(len(x)), near], kind="stable")[: len(empty)]
            c[empty] = x[far]
    return c
