"""Operator 6, nearest neighbours over learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced partitions:
recursive bisection at the median of the graph's second eigenvector, then swaps of pairs
that lower the number of cut edges. A small network learns to tell a vector's partition,
from its own and its neighbours' partitions; it assigns every vector to the partition it
finds most probable and routes every query to the most probable several. How many those
are is measured, not assumed: for held-out queries the exact neighbours among all vectors
are found, and the fewest probes are taken that reach `RECALL` of them. Beyond
`MAX_PARTITIONS` partitions of `ROWS_PER_PARTITION` vectors each partition is learned and
cut again, by its own task from a sample of its own, with a router of its own; the probes
of both levels are measured together. Inside the probed partitions scores and the order of ties are exact, so the only loss is a neighbour in a partition not probed.

Every row is a query. Defined results: rows that are no usable vector (see
`vectors.usable_vectors`) have no neighbours and are none; the vector itself isn't its own
neighbour; equal scores go by the lesser id; with fewer than k others all are returned.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialise
from skein.llm.vectors import cosines, matrix, sample, units, usable_vectors
from skein.operators import knn

K = 10
ROWS_PER_PARTITION, MAX_PARTITIONS = 4_096, 256
SAMPLE_ROWS, SAMPLE_PER_PARTITION = 16_384, 256
CALIBRATION_QUERIES = 256
RECALL = 0.96
HIDDEN, EPOCHS = 64, 40
GRAPH_K = 10
BLOCK = 1 << 22  # scores held at once
BROADCAST_BYTES, PART_BYTES, TASK_ROWS = 256 << 20, 16 << 20, 1 << 12  # vectors that may be sent to every executor, what a worker holds of them, queries of a batch
DENSE = 0.1  # share of partitions probed from which sending all vectors is less than sending queries to each
SLOT_QUERIES = 1 << 17  # queries that meet a partition in one task
RESULT = "query_id long, neighbour_id long, rank int, score double"


def top_k(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best rows of x for each query, best first; own: excluded position."""
    k = min(k, len(x))
    at, best = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    step = max(1, BLOCK // max(1, len(x)))
    for i in range(0, len(q), step):
        s = (q[i: i + step] @ x.T).astype(np.float64)
        if own is not None:
            mine = own[i: i + step]
            rows = np.flatnonzero(mine >= 0)
            s[rows, mine[rows]] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(s), 1))
        value = np.take_along_axis(s, part, 1)
        order = np.lexsort((part, -value), axis=1)
        at[i: i + step], best[i: i + step] = np.take_along_axis(part, order, 1), np.take_along_axis(value, order, 1)
    return at, best


def best_cosines(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, cosine) of the k best rows of x for each query, of equal cosines the first.

    float32 scores only choose candidates: all within their rounding of the k-th best. Of equal
    rows of x no more than the first k + 1 can be neighbours, one of which may be the query.
    """
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1), return_inverse=True)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    copy = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.sort(order[copy <= k])
    place = np.full(len(x) + 1, -1)  # the last one is that of own = -1
    place[kept] = np.arange(len(kept))
    x, own = x[kept], place[own]
    near, far = [(v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) for v in (q, x)]
    slack = np.float32((x.shape[1] + 4) * 2.0**-23)
    step, piece, out = max(1, BLOCK // len(x)), max(1, BLOCK // x.shape[1]), []
    for i in range(0, len(q), step):
        s = near[i: i + step] @ far.T
        rows = np.flatnonzero(own[i: i + step] >= 0)
        s[rows, own[i: i + step][rows]] = -np.inf
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] - slack if k < len(x) else np.full(len(s), -np.inf, np.float32)
        row, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        score = np.concatenate([np.empty(0), *(cosines(q[i + row[j: j + piece]], x[at[j: j + piece]]) for j in range(0, len(row), piece))])
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((i + row[top], kept[at[top]], score[top]))
    return tuple(map(np.concatenate, zip(*out)))


def bisect(graph: np.ndarray, weight: np.ndarray, nodes: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes with few edges between them; graph: neighbours of each node."""
    n = len(nodes)
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(n)
    to = place[graph[nodes]]
    inside = to >= 0
    src = np.repeat(np.arange(n), graph.shape[1])[inside.reshape(-1)]
    dst = to.reshape(-1)[inside.reshape(-1)]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    root = np.sqrt(degree)
    v = rng.normal(size=n)
    for _ in range(60):  # power iteration on the normalised adjacency, without its first vector
        v -= root * (root @ v) / (root @ root)
        v = 0.5 * v + 0.5 * np.bincount(a, weights=(v / root)[b], minlength=n) / root
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, np.int8)
    side[np.argsort(v / root, kind="stable")[n // 2:]] = 1
    for _ in range(8):  # swap equally many of either side while the cut gets smaller
        other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * other - degree
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
        if not good:
            break
        before = (side[a] != side[b]).sum()
        new = side.copy()
        new[left[:good]], new[right[:good]] = 1, 0
        if (new[a] != new[b]).sum() >= before:
            break
        side = new
    return nodes[side == 0], nodes[side == 1]


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """The partition of each node; parts is a power of two, sizes differ by a few at most."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, None, g, rng)]
    label = np.zeros(len(graph), np.int64)
    for k, g in enumerate(groups):
        label[g] = k
    return label


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions from the most probable to the least, for each row."""
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argsort(-z, axis=1, kind="stable")


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, seed: int = 2) -> Router:
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1.0 / graph.shape[1])
    target /= target.sum(1, keepdims=True)
    r = Router(rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, parts)).astype(np.float32), np.zeros(parts, np.float32))
    params = [r.w1, r.b1, r.w2, r.b2]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 512):
            b = order[i: i + 512]
            h = np.maximum(x[b] @ r.w1 + r.b1, 0)
            z = h @ r.w2 + r.b2
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[b]) / len(b)
            gh = (g @ r.w2.T) * (h > 0)
            t += 1
            for k, grad in enumerate((x[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad * grad - v[k])
                params[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return r


@dataclass
class Tree:
    """The routers of one or two levels; a partition is numbered top * width + inner."""

    top: Router
    inner: list[Router | None] | None = None
    width: int = 1
    outer_probes: int = 1
    inner_probes: int = 1

    def _below(self, part: int, x: np.ndarray) -> np.ndarray:
        router = self.inner[part] if self.inner else None
        return np.zeros((len(x), 1), np.int64) if router is None else router.order(x)

    def routes(self, x: np.ndarray) -> np.ndarray:
        """The partitions to probe for each row, its own first; -1 where there are fewer."""
        tops = self.top.order(x)[:, : self.outer_probes]
        out = np.full((len(x), tops.shape[1], self.inner_probes), -1, np.int64)
        for part in np.unique(tops):
            row, place = np.nonzero(tops == part)
            subs = self._below(part, x[row])[:, : self.inner_probes]
            out[row, place, : subs.shape[1]] = part * self.width + subs
        return out.reshape(len(x), -1)

    def home(self, x: np.ndarray) -> np.ndarray:
        out = self.top.order(x)[:, 0]
        sub = np.zeros(len(x), np.int64)
        for part in np.unique(out):
            rows = np.flatnonzero(out == part)
            sub[rows] = self._below(part, x[rows])[:, 0]
        return out * self.width + sub

    def places(self, q: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the partitions `home` (one row a query) come in the queries' orders, on either level."""
        outer = np.take_along_axis(np.argsort(self.top.order(q), axis=1), home // self.width, 1)
        inner = np.zeros(home.shape, np.int64)
        for part in np.unique(home // self.width):
            rank = np.argsort(self._below(part, q), axis=1)
            row, column = np.nonzero(home // self.width == part)
            inner[row, column] = rank[row, home[row, column] % self.width]
        return outer, inner


def fit_partitions(x: np.ndarray, parts: int) -> Router:
    """Neighbour graph, balanced partitions and their router of sampled vectors."""
    graph = top_k(x, x, min(GRAPH_K, max(1, len(x) - 1)), np.arange(len(x)))[0]
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) // 8)))))
    return fit_router(x, graph, balanced_partition(graph, parts), parts)


def fit_inner(vectors: DataFrame, dim: int, n: int, top: Router, parts: int, subs: int) -> list[Router | None]:
    """A router for each partition of the top level, each fitted in a task from a sample of that partition."""
    spark = vectors.sparkSession
    shared, wanted = spark.sparkContext.broadcast(top), max(512, subs * SAMPLE_PER_PARTITION)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.order(units(b.column(1), dim))[:, 0].astype(np.int32))], names=["vec_id", "v", "part"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"part": pdf["part"][:1], "router": [pickle.dumps(fit_partitions(units(pdf["v"], dim), subs))]})

    h = F.xxhash64("vec_id")
    share = min(1.0, 8 * wanted * parts / n)  # enough of every partition that isn't far smaller than most
    some = vectors.where(F.pmod(h, F.lit(1 << 20)) <= int(share * (1 << 20)))
    placed = some.mapInArrow(place, "vec_id long, v binary, part int").withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(h, "vec_id"))).where(F.col("r") <= wanted).drop("r")
    found = {r["part"]: pickle.loads(r["router"]) for r in placed.groupBy("part").applyInPandas(fit, "part int, router binary").collect()}  # one small network a partition
    return [found.get(k) for k in range(parts)]


def fewest_probes(outer: np.ndarray, inner: np.ndarray, parts: int, width: int, recall: float) -> tuple[int, int]:
    """(outer, inner) probes of least product that reach the share `recall` of neighbours at these places."""
    found = np.zeros((parts, width))
    np.add.at(found, (outer, inner), 1.0)
    share = found.cumsum(0).cumsum(1) / max(1, len(outer))
    cost = np.where(share >= recall, np.outer(np.arange(1, parts + 1), np.arange(1, width + 1)), np.inf) if len(outer) else np.ones((1, 1))
    if not np.isfinite(cost).any():
        return parts, width
    a, b = np.unravel_index(cost.argmin(), cost.shape)
    return int(a) + 1, int(b) + 1


def learn(vectors: DataFrame, dim: int, n: int, k: int, rows_per_partition: int) -> Tree:
    """Partitions and routing from samples; the number of probes from exact neighbours."""
    parts = subs = 1
    while parts < MAX_PARTITIONS and parts * rows_per_partition < n:
        parts *= 2
    while subs < MAX_PARTITIONS and parts * subs * rows_per_partition < n:
        subs *= 2
    _, x = sample(vectors, min(SAMPLE_ROWS, max(2_048, parts * SAMPLE_PER_PARTITION)), dim)
    top = fit_partitions(x, parts)
    parts = top.w2.shape[1]
    tree = Tree(top) if subs == 1 else Tree(top, fit_inner(vectors, dim, n, top, parts, subs), subs)
    # held-out queries: not the sample's vectors but those of the largest hashes
    spark = vectors.sparkSession
    rows = vectors.orderBy(F.xxhash64("vec_id").desc(), "vec_id").limit(CALIBRATION_QUERIES).toPandas()
    q_ids, q = rows["vec_id"].to_numpy(np.int64), units(rows["v"], dim)
    shared = spark.sparkContext.broadcast((q_ids, q, tree))

    def exact(batches):
        q_ids, q, tree = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, own = units(b.column(1), dim), np.full(len(q_ids), -1)
            ids = b.column(0).to_numpy()
            place = {int(v): i for i, v in enumerate(ids)}
            for j, v in enumerate(q_ids.tolist()):
                own[j] = place.get(v, -1)
            at, score = top_k(q, x, k + 1, own)
            outer, inner = tree.places(q, tree.home(x)[at])
            keep = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, at.shape[1])[keep.reshape(-1)]), pa.array(ids[at][keep]), pa.array(score[keep]), pa.array(outer[keep]), pa.array(inner[keep])], names=["q", "id", "score", "outer", "inner"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = vectors.mapInArrow(exact, "q long, id long, score double, outer long, inner long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    places = np.array([(r["outer"], r["inner"]) for r in near.select("outer", "inner").collect()], np.int64).reshape(-1, 2)  # at most k a query
    tree.outer_probes, tree.inner_probes = fewest_probes(places[:, 0], places[:, 1], parts, tree.width, RECALL)
    return tree


def nearest(table: DataFrame, k: int = K, rows_per_partition: int | None = None) -> DataFrame:
    """query_id, neighbour_id, rank, score (cosine, six decimals) of k neighbours of every row."""
    rows_per_partition = rows_per_partition or ROWS_PER_PARTITION
    spark = table.sparkSession
    found, dim = usable_vectors(table)
    vectors = materialise(found)
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], RESULT)
    tree = learn(vectors, dim, n, k, rows_per_partition)
    if n * dim * 4 <= BROADCAST_BYTES and tree.outer_probes * tree.inner_probes >= DENSE * tree.top.w2.shape[1] * tree.width:
        return in_place(vectors, tree, dim, n, k)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            order = r.routes(units(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    routed = materialise(vectors.mapInArrow(route, "vec_id long, v binary, parts array<int>"))
    # queries of one partition are spread over slots, each of which gets all its members
    partitions = tree.top.w2.shape[1] * tree.width
    slots = max(1, -(-n * tree.outer_probes * tree.inner_probes // (partitions * SLOT_QUERIES)))
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int")
    members = routed.select(F.element_at("parts", 1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "vec_id", "v")
    queries = routed.select(F.explode("parts").alias("part"), slot.alias("slot"), "vec_id", "v").where("part >= 0")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "neighbour_id": [], "score": []})
        x = x.sort_values("vec_id")
        ids = x["vec_id"].to_numpy()
        q_ids = q["vec_id"].to_numpy()
        place = np.searchsorted(ids, q_ids)
        own = np.where((place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == q_ids), place, -1)
        row, at, score = best_cosines(matrix(q["v"], dim), matrix(x["v"], dim), k, own)
        return pd.DataFrame({"query_id": q_ids[row], "neighbour_id": ids[at], "score": score})

    hits = queries.groupBy("part", "slot").cogroup(members.groupBy("part", "slot")).applyInPandas(search, "query_id long, neighbour_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "neighbour_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def in_place(vectors: DataFrame, tree: Tree, dim: int, n: int, k: int) -> DataFrame:
    """The search of `nearest` where a large share of partitions is probed: vectors are sent to every executor in pieces.

    A worker holds one piece at a time; what isn't near is left out by products with the whole piece, and
    the probes are asked of the rest. A query isn't shuffled or written once for each partition it probes, nor its finds.
    """
    spark = vectors.sparkSession
    pieces, partitions = max(1, -(-n * dim * 4 // PART_BYTES)), tree.top.w2.shape[1] * tree.width
    router = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(router.value.home(units(b.column(1), dim)).astype(np.int32))], names=["vec_id", "v", "part"])

    placed = materialise(vectors.mapInArrow(place, "vec_id long, v binary, part int"))

    def send(piece: int):
        rows = placed.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece).select("part", "vec_id", "v").toArrow()
        part, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.float32).reshape(-1, dim)
        order = order[knn.few_copies(x[order], part[order], k + 1)]
        return spark.sparkContext.broadcast((part[order], ids[order], x[order]))

    shared = [send(piece) for piece in range(pieces)]

    def search(batches):
        for b in batches:
            for i in range(0, b.num_rows, TASK_ROWS):
                some = b.slice(i, TASK_ROWS)
                ids, q = some.column(0).to_numpy(), np.frombuffer(b"".join(some.column(1).to_pylist()), np.float32).reshape(-1, dim)
                close, asked = units(some.column(1), dim), np.zeros((len(ids), partitions), bool)
                for j in range(0, len(ids), 512):
                    probes = router.value.routes(close[j: j + 512])
                    row, at = np.nonzero(probes >= 0)
                    asked[j + row, probes[row, at]] = True
                best, near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                for one in shared:
                    part, its, x = one.value
                    knn._improve(best, near, q, ids, x, its, close, lambda r, at, part=part: asked[r, part[at]])
                    if len(shared) > 1:
                        del part, its, x, one._value  # read again from the worker's disk when it is next asked for
                at, rank = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near[at, rank]), pa.array((rank + 1).astype(np.int32)), pa.array(best[at, rank])], names=["query_id", "neighbour_id", "rank", "score"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return placed.select("vec_id", "v").repartition(tasks, "vec_id").mapInArrow(search, RESULT).withColumn("score", F.round("score", 6))


def recall(table: DataFrame, k: int = K, rows_per_partition: int = 25) -> DataFrame:
    """One row: vectors, their exact neighbours, and whether `nearest` finds 0.9 of them.

    Partitions are small, so that routing is put to the test on small tables too; the exact
    side is that of all pairs.
    """
    found, dim = usable_vectors(table)

    def listed(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * dim, flat)], names=["paper_id", "embedding"])

    exact = materialise(knn.knn(found.mapInArrow(listed, "paper_id long, embedding array<float>"), k).select(F.col("src").alias("query_id"), F.col("dst").alias("neighbour_id")))
    routed = nearest(table, k, rows_per_partition).select("query_id", "neighbour_id")
    hits = exact.join(routed, ["query_id", "neighbour_id"], "left_semi").agg(F.count("*").alias("hits"))
    return exact.agg(F.countDistinct("query_id").alias("vectors"), F.count("*").alias("neighbours")).crossJoin(hits).select("vectors", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("reached"))


def recall_sql(k: int = K) -> str:
    return f"SELECT count(*) AS vectors, CAST(count(*) * least({k}, count(*) - 1) AS BIGINT) AS neighbours, true AS reached FROM embeddings"


def oracle_sql(k: int = K) -> str:
    """Exact neighbours in DuckDB; the same where one partition holds all, as in small tables."""
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, neighbour_id) AS k FROM s)
SELECT query_id, neighbour_id, CAST(k AS INTEGER) AS rank, round(c, 6) AS score FROM r WHERE k <= {k}"""
