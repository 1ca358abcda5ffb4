"""Exact nearest neighbours, whitening and factors."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.sources.storage import materialise

MATRIX_BYTES, BLOCK_ROWS = 16 << 20, 4_096  # what a worker holds of the vectors at once; at least so many rows
SCORES, PIECE = 1 << 21, 1 << 15  # scores held at once; pairs that are multiplied in doubles at once
TASK_ROWS = 1 << 13  # queries that meet all vectors in one task


def _rows(column: pa.ListArray, d: int) -> np.ndarray:
    """The vectors of a list column; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), flat.dtype)
    out[np.arange(d) < size[:, None]] = flat
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return sum((x[:, j].astype(np.float64) ** 2 for j in range(x.shape[1])), np.zeros(len(x)))


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows with rows, summed in order and in doubles, so that equal vectors get equal scores wherever they lie."""
    dot = sum((q[:, j].astype(np.float64) * x[:, j] for j in range(q.shape[1])), np.zeros(len(q)))
    size = np.sqrt(_squares(q)) * np.sqrt(_squares(x))
    return np.clip(np.divide(dot, size, out=np.zeros(len(q)), where=size != 0), -1, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(_squares(x))[:, None]
    return (x / np.where(n == 0, 1, n)).astype(np.float32)


def _improve(best: np.ndarray, near: np.ndarray, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, close: np.ndarray | None = None, allowed=None) -> None:
    """Takes those of x that are closer into best (scores) and near (ids), k columns, best first, ties to the lesser id; ids ascend.

    Products in single precision leave out what can't be among the k best by more than their error;
    the others are computed in doubles. close: q as units, if known; allowed: which pairs (row of q, row of x) count,
    of arrays that broadcast.
    """
    k, d = best.shape[1], x.shape[1]
    slack, far, close = np.float32((d + 8) * 2.0**-23), _unit(x), _unit(q) if close is None else close
    width = min(len(x), BLOCK_ROWS)
    height = max(1, SCORES // max(1, width))
    for i in range(0, len(q), height):
        for j in range(0, len(x), width):
            s, mine = close[i: i + height] @ far[j: j + width].T, q_ids[i: i + height]
            low, high = (np.searchsorted(ids[j: j + width], mine, side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(mine)), high - low)
            s[own, np.arange(len(own)) - np.repeat(np.cumsum(high - low) - high, high - low)] = -np.inf  # no neighbour of itself
            least = best[i: i + height, -1].astype(np.float32)
            free = np.flatnonzero(np.isneginf(least))
            if len(free) and allowed is not None:
                s[free] = np.where(allowed((i + free)[:, None], np.arange(j, j + s.shape[1])[None]), s[free], -np.inf)
            if len(free) and s.shape[1] > k:
                least[free] = np.partition(s[free], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            row, at = np.nonzero(s >= np.maximum(least - slack, np.float32(-2))[:, None])
            del s
            if allowed is not None:
                good = allowed(i + row, j + at)
                row, at = row[good], at[good]
            if not len(row):
                continue
            score = np.concatenate([_cosines(q[i + row[c: c + PIECE]], x[j + at[c: c + PIECE]]) for c in range(0, len(row), PIECE)])
            few = i + np.unique(row)  # each has its k before, some of them still empty
            of, score, id_ = np.concatenate([i + row, np.repeat(few, k)]), np.concatenate([score, best[few].reshape(-1)]), np.concatenate([ids[j + at], near[few].reshape(-1)])
            order = np.lexsort((id_, -score, of))
            top = order[np.searchsorted(of[order], few)[:, None] + np.arange(k)]
            best[few], near[few] = score[top], id_[top]


def _slices(labels: np.ndarray) -> dict:
    """Where each label lies in sorted labels."""
    first = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else np.zeros(0, int)
    return {labels[a]: slice(a, b) for a, b in zip(first, [*first[1:], len(labels)])}


def few_copies(x: np.ndarray, labels: np.ndarray, copies: int) -> np.ndarray:
    """Marks the first rows of each label that are equal: of those in order of their ids, no more can be among the k best."""
    return (pd.DataFrame({"label": labels, "row": [r.tobytes() for r in x]}).groupby(["label", "row"], sort=False).cumcount() < copies).to_numpy()


def knn(papers: DataFrame, k: int = 8, within: Column | None = None) -> DataFrame:
    """src, dst, rank, score: the k papers of greatest cosine for each, ties to the lesser id; within: only of an equal value.

    The vectors are sent to every executor in parts of MATRIX_BYTES, which lie on its disk; a worker
    holds one part at a time, and some thousand queries with their k best so far. So its memory
    doesn't grow with the table, and the result isn't shuffled. The work is that of all pairs.
    """
    spark, label = papers.sparkSession, F.lit("") if within is None else within.cast("string")
    kind = "array<float>" if dict(papers.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = papers.select(F.col("paper_id").cast("long").alias("paper_id"), F.col("embedding").cast(kind).alias("embedding"), label.alias("label")).where("paper_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL")
    size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
    n, d = size["n"], size["d"] or 0
    if n < 2:
        return spark.createDataFrame([], "src long, dst long, rank int, score double")
    if within is None and size["least"] != d:
        raise ValueError(f"vectors of {size['least']} and {d} dimensions have no cosine")
    parts = -(-n // max(BLOCK_ROWS, MATRIX_BYTES // max(1, 8 * d)))
    if parts > 1:
        v = materialise(v)

    def arrays(table):
        ids, x, labels = table.column(0).to_numpy(), _rows(table.column(1), d), table.column(2).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(2).to_numpy()
        order = np.lexsort((ids, labels))
        return ids[order], x[order], labels[order]

    def send(part: int):
        mine = v.where(F.pmod(F.xxhash64("paper_id"), F.lit(parts)) == part) if parts > 1 else v
        ids, x, labels = arrays(mine.toArrow())
        good = np.isfinite(_squares(x)) & few_copies(x, labels, k + 1)
        return spark.sparkContext.broadcast((ids[good], x[good], _slices(labels[good])))

    shared = [send(part) for part in range(parts)]

    def local(batches):
        for b in batches:
            for i in range(0, b.num_rows, TASK_ROWS):
                ids, x, labels = arrays(b.slice(i, TASK_ROWS))
                best, near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                for one in shared:
                    its, y, where = one.value
                    for name, at in _slices(labels).items():
                        if name in where:
                            _improve(best[at], near[at], x[at], ids[at], y[where[name]], its[where[name]])
                    if len(shared) > 1:
                        del its, y, where, one._value  # it is read again from the worker's disk when it is next asked for
                row, rank = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near[row, rank]), pa.array((rank + 1).astype(np.int32)), pa.array(best[row, rank])], names=["src", "dst", "rank", "score"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return v.repartition(tasks, "paper_id").mapInArrow(local, "src long, dst long, rank int, score double")


def from_distances(distances: DataFrame, k: int) -> DataFrame:
    """src, dst, rank of the k least distances (src, dst, distance) of each source, ties to the lesser id; itself left out."""
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return distances.where("src <> dst").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank")


def nearest_to(papers: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k papers most like one vector; none for k <= 0 or another dimension."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = V.cosine(F.col("embedding"), q)
    return papers.select("paper_id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "paper_id").limit(max(0, k))


def related(neighbours: DataFrame, k: int = 5) -> DataFrame:
    return neighbours.where(F.col("rank") <= k)


def moments(papers: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of all vectors in one pass; only d x d numbers reach the driver."""

    def part(batches):
        n, s, o = 0, 0, 0
        for b in batches:
            x = np.array(b["embedding"].tolist(), np.float64)
            if len(x):
                n, s, o = n + len(x), s + x.sum(0), o + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "o": [o.tobytes()]})

    rows = papers.where("embedding IS NOT NULL").select("embedding").mapInPandas(part, "n long, s binary, o binary").collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = sum(r["n"] for r in rows)
    mean = sum(np.frombuffer(r["s"]) for r in rows) / n
    outer = sum(np.frombuffer(r["o"]) for r in rows).reshape(len(mean), len(mean)) / n
    return n, mean, outer - np.outer(mean, mean)


def principal_axes(papers: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, variances); each axis' largest loading is positive, empty directions are dropped."""
    n, mean, cov = moments(papers)
    value, axes = np.linalg.eigh(cov)
    order = np.argsort(-value)[: min(k, n, len(mean))]
    order = order[value[order] > 1e-10 * max(value.max(), 1e-300)]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mean, axes, value[order]


def project(papers: DataFrame, mean: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    from pyspark.sql import types

    schema = types.StructType([*papers.drop(out).schema.fields, types.StructField(out, types.ArrayType(types.DoubleType()))])

    def run(batches):
        for b in batches:
            x = np.array(b["embedding"].tolist(), np.float64).reshape(-1, len(mean))
            yield b.drop(columns=[out], errors="ignore").assign(**{out: list((x - mean) @ matrix)})

    return papers.where("embedding IS NOT NULL").mapInPandas(run, schema)


def whiten(papers: DataFrame, k: int = 128) -> DataFrame:
    """embedding projected on its principal axes, each with variance 1."""
    mean, axes, variance = principal_axes(papers, k)
    return project(papers.select("paper_id", "cluster_id", "year", "embedding"), mean, axes / np.sqrt(variance), "embedding")


def factor_loadings(papers: DataFrame, k: int = 8) -> DataFrame:
    """loadings: the k leading singular directions of the centred raw vectors."""
    mean, axes, _ = principal_axes(papers, k)
    return project(papers.select("paper_id", "cluster_id", "year", "embedding"), mean, axes, "loadings").drop("embedding")
