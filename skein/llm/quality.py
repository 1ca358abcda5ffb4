"""Operator 1, quality classifier: random-indexing word vectors, pooled, a two-layer network.

Every token hashes to one of `BUCKETS` words. Each word has a sparse ternary index vector
drawn from its number; a word's vector is the sum of the index vectors of its neighbours
within `WINDOW` tokens, over all documents. Each task sums into one table of fixed size, so
what is shuffled grows with the number of tasks and the model never grows. A document is
the mean of its words' unit vectors, frequent words weighted down by the corpus counts.

The network (one hidden layer, softmax) is fitted on at most `fit_rows` labelled documents,
those with the smallest hash of their id; a quarter of them is held out to set the
temperature by which logits are divided, so that probabilities are calibrated. Documents
are kept from probability `THRESHOLD`, or from the greatest lower one at which at most
`MOST_LOST` of the good held-out documents are rejected.

Defined results: a text without tokens (null, empty, blank) has probability null and is
rejected; a null doc_id keeps its row; repeated rows get equal scores; labels that are
null or conflict are ignored or resolved to the lower one. Without labelled rows of both
classes nothing can be learned: probability null and every row is kept.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_rows, map_texts, slices, text_buffers
from skein.llm.tokens import mix, sum_rows, words

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
BLOCKS = 16
SLICE_BYTES = 1 << 20
FIT_ROWS = 10_000
HIDDEN, EPOCHS, RATE = 24, 500, 0.02
THRESHOLD, MOST_LOST = 0.5, 0.002  # documents are kept from this probability, or a lower one that loses at most so many good held-out ones
SIF = 1e-3
RESULT = "doc_id long, probability double, keep boolean"


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the non-zero elements of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1


def token_buckets(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, rows, first = words(offsets, raw, symbols=True)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), rows, first


def word_table(docs: DataFrame) -> np.ndarray:
    """For each bucket its context sums and its count, over all documents."""

    def part(batches):
        where, sign = index_vectors()
        total = np.zeros((BUCKETS, DIM + 1))
        flat = BUCKETS * DIM
        for b in batches:
            off, raw = text_buffers(b.column(0))
            for i, j in slices(off, SLICE_BYTES):
                t, rows, _ = token_buckets(off[i: j + 1] - off[i], raw[off[i]: off[j]])
                total[:, DIM] += np.bincount(t, minlength=BUCKETS)
                for d in range(1, WINDOW + 1):
                    near = rows[d:] == rows[:-d]
                    a, c = t[:-d][near], t[d:][near]
                    for x, y in ((a, c), (c, a)):
                        for q in range(NONZERO):
                            total[:, :DIM] += np.bincount(x * DIM + where[y, q], weights=sign[y, q], minlength=flat).reshape(BUCKETS, DIM)
        # whole numbers, so that sums don't depend on how rows are divided among tasks
        blocks = total.astype(np.int32 if np.abs(total).max() < 2**31 else np.int64).reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS // BLOCKS * (DIM + 1), np.int64)
        for x in pdf["sums"]:
            total += np.frombuffer(x, np.int32 if len(x) == 4 * len(total) else np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "sums": [total.tobytes()]})

    parts = map_texts(docs.select(docs["text"].cast("string").alias("text")), part, "block int, sums binary")
    rows = parts.groupBy("block").applyInPandas(add, "block int, sums binary").collect()
    table = np.zeros((BLOCKS, BUCKETS // BLOCKS * (DIM + 1)))
    for r in rows:
        table[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return table.reshape(BUCKETS, DIM + 1)


def pooling_matrix(table: np.ndarray) -> np.ndarray:
    """Each bucket's weighted unit vector, and its weight in the last column."""
    counts = table[:, DIM]
    vectors = table[:, :DIM] / np.maximum(np.linalg.norm(table[:, :DIM], axis=1, keepdims=True), 1e-9)
    share = counts / max(1.0, counts.sum())
    vectors = vectors - (share[:, None] * vectors).sum(axis=0)
    weight = SIF / (SIF + share)
    return np.column_stack([vectors * weight[:, None], weight]).astype(np.float32)


def pool(pooling: np.ndarray, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of tokens) of each text.

    The features are the mean vector, its norm, the mean product of the unit vectors of
    adjacent tokens (near 1 where words are repeated) and the log of the token count.
    """
    t, rows, first = token_buckets(offsets, raw)
    values, n = pooling[t], np.diff(first)
    sums = sum_rows(values, first)
    mean = sums[:, :DIM] / np.maximum(sums[:, DIM:], 1e-9)
    near = np.zeros(len(t), np.float32)
    if len(t) > 1:
        near[1:] = np.einsum("ij,ij->i", values[1:, :DIM], values[:-1, :DIM]) / (values[1:, DIM] * values[:-1, DIM])
        near[1:][rows[1:] != rows[:-1]] = 0
    beside = sum_rows(near, first) / np.maximum(n - 1, 1)
    return np.column_stack([mean, np.linalg.norm(mean, axis=1), beside, np.log1p(n)]), n


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0
    threshold: float = THRESHOLD

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on the cross-entropy, then the temperature on the held-out quarter."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 3 // 4)
    tr, held = order[:cut], order[cut:] if cut < len(x) else order
    net = Network(x[tr].mean(axis=0), x[tr].std(axis=0) + 1e-6, rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, 2)), np.zeros(2))
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z0, hot = (x[tr] - net.mean) / net.scale, np.eye(2)[y[tr]]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z0 @ net.w1 + net.b1)
        z = h @ net.w2 + net.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) / len(tr)
        gh = (g @ net.w2.T) * (1 - h * h)
        for k, grad in enumerate((z0.T @ gh + 1e-4 * net.w1, gh.sum(axis=0), h.T @ g + 1e-4 * net.w2, g.sum(axis=0))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            params[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    z = net.logits(x[held])
    gap = np.where(y[held] == 1, z[:, 1] - z[:, 0], z[:, 0] - z[:, 1])
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    net.temperature = float(grid[np.argmin([np.logaddexp(0, -gap / t).mean() for t in grid])])
    good = np.sort(net.probability(x[held][y[held] == 1]))
    if len(good):
        net.threshold = float(min(THRESHOLD, good[int(MOST_LOST * len(good))]))
    return net


@dataclass
class QualityModel:
    pooling: np.ndarray
    network: Network | None

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, known) of each text."""
        x, n = pool(self.pooling, offsets, raw)
        return (self.network.probability(x) if self.network else np.zeros(len(x))), n > 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors from all of docs; the network from at most fit_rows labelled documents."""
    pooling = pooling_matrix(word_table(docs))
    h = F.xxhash64("doc_id")
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(h, "doc_id").limit(fit_rows)
    wanted = {r["doc_id"]: int(r["quality"] > 0) for r in chosen.collect()}
    if len(set(wanted.values())) < 2:
        return QualityModel(pooling, None)
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in wanted], "doc_id long"))  # at most fit_rows rows
    shared = spark.sparkContext.broadcast(pooling)

    def vectors(batches):
        for b in batches:
            off, raw = text_buffers(b.column(1))
            for i, j in slices(off, SLICE_BYTES):
                x, n = pool(shared.value, off[i: j + 1] - off[i], raw[off[i]: off[j]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([v.tobytes() for v in x.astype(np.float64)], pa.binary()), pa.array(n)], names=["doc_id", "x", "n"])

    sample = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(keys, "doc_id", "left_semi")
    rows = sorted((r["doc_id"], r["x"]) for r in map_texts(sample, vectors, "doc_id long, x binary, n long").where("n > 0").collect())
    y = np.array([wanted[i] for i, _ in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(pooling, None)
    return QualityModel(pooling, fit(np.array([np.frombuffer(x, np.float64) for _, x in rows]), y))


def _scores(model: QualityModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off, raw = text_buffers(column)
    got = [model.score(off[i: j + 1] - off[i], raw[off[i]: off[j]]) for i, j in slices(off, SLICE_BYTES)]
    if not got:
        return np.zeros(0), np.zeros(0, bool)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def classify(docs: DataFrame, model: QualityModel, threshold: float | None = None) -> DataFrame:
    """doc_id, probability of good quality and the decision, for every row; threshold: other than the model's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            p, known = _scores(m, b.column(1))
            if m.network is None:
                keep, known = np.ones(len(p), bool), np.zeros(len(p), bool)
            else:
                keep = known & (p >= (m.network.threshold if threshold is None else threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, mask=~known), pa.array(keep)], names=["doc_id", "probability", "keep"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, RESULT)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float | None = None) -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            p, known = _scores(m, b.column(at))
            yield b if m.network is None else b.filter(pa.array(known & (p >= (m.network.threshold if threshold is None else threshold))))

    return map_rows(docs, run)
