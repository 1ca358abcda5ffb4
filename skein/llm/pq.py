"""Operator 9, near-duplicate embeddings over inverted lists, without losing a pair.

Vectors belong to the inverted list of their nearest coarse centroid. A pair with cosine at
least `threshold` is at most r = sqrt(2 - 2 * threshold) apart. A vector can have such a
partner only in lists whose bisecting hyperplane with its own list is within r and whose
shell of member distances meets its distance plus or minus r.

Lists that follow one another are put together in blocks, long ones are cut into several.
Every two blocks are one task, and a vector goes to those of its block with blocks that can
hold a partner, so each pair of vectors meets in one task at most. There each list meets
the vectors that can have a partner in it: first by their parts along the leading principal
axes of a sample, where with x = (p, rest) the cosine is at most p.p' + |rest| |rest'|; what
is left gets its exact cosine. All tests are inequalities that hold for every true pair, so
none is lost; sample, lists, blocks and the number of axes only move the cost.

`near_duplicates` gives one row for each vector: its group (the connected components of the
pairs, named by their least id) and the number of its partners. Equal vectors are searched
as one, and a task only gives these counts and the components of its own pairs, so a group
of thousands is never expanded into its pairs. `near_pairs` gives all pairs.

Defined results: rows that are no usable vector (see `vectors.usable_vectors`) have no pair
and are their own group; equal ids are one vector; a row with null id can't be named: group
null, not a duplicate.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialise
from skein.llm.components import components
from skein.llm.vectors import cosines, kmeans, matrix, sample, units, usable_vectors

THRESHOLD = 0.95
ROWS_PER_LIST, MAX_LISTS = 1_024, 1_024
SAMPLE_ROWS = 16_384
BLOCK_BYTES = 16 << 20  # of the vectors of a block
TILE, EXACT_BYTES, ROUTED_ROWS = (512, 4_096), 16 << 20, 2_048  # of what is worked on at once
EXACT_COST = 25  # of an element of an exact cosine, in elements of a product of matrices
DENSE = 1 / 64  # share of a tile from which on a product of its vectors is cheaper than exact cosines
SLACK = 1e-4  # for float32 arithmetic, on the side of more candidates
RESULT = "a long, b long, cosine double"
LINKED = "vec_id long, least long, links long"


@dataclass
class Lists:
    """Centroids, how far they are apart, the shells of their lists and the lists' blocks; an empty list has no block."""

    coarse: np.ndarray
    between: np.ndarray
    axes: np.ndarray  # dimension, leading axis
    reach: float
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # block
    parts: np.ndarray  # blocks

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = self.coarse.astype(np.float64)
        return np.sqrt(np.maximum((x.astype(np.float64) ** 2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))

    def partners(self, x: np.ndarray, home: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether each of the lists `which` can hold a partner of each row."""
        use = np.empty((len(x), len(which)), bool)
        for i in range(0, len(x), ROUTED_ROWS):
            d, own = self.distances(x[i: i + ROUTED_ROWS]), home[i: i + ROUTED_ROWS]
            near, other = d[np.arange(len(d)), own][:, None], d[:, which]
            plane = (other**2 - near**2) / (2 * np.maximum(self.between[own][:, which], 1e-9))
            can = (plane <= self.reach) & (other <= self.hi[which] + self.reach) & (other >= self.lo[which] - self.reach)
            use[i: i + len(d)] = can | (which == own[:, None])
        return use

    def block(self, ids: np.ndarray, home: np.ndarray) -> np.ndarray:
        mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[home] + (mixed % self.parts[home].astype(np.uint64)).astype(np.int64)


def with_rest(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The parts of unit vectors along the axes and the length of what is left, which needs float64."""
    p = x @ axes
    return np.concatenate((p, np.sqrt(np.maximum(1 - (p**2).sum(1, keepdims=True), 0))), 1).astype(np.float32)


def leading_axes(x: np.ndarray, threshold: float) -> np.ndarray:
    """As many principal axes, largest first, as make the search cheapest over pairs of a sample."""
    x = x.astype(np.float64)
    axes = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    some, dim = x[:1_024], x.shape[1]

    def cost(k: int) -> float:
        p = with_rest(some, axes[:, :k])
        return k + ((p @ p.T >= threshold - SLACK).mean() - 1 / len(p)) * EXACT_COST * dim

    return axes[:, : min(range(min(4, dim), dim + 1, 4), key=cost)]


def chain(c: np.ndarray) -> list[int]:
    """The rows in an order in which each is followed by the nearest that is left."""
    order, left = [0], np.ones(len(c), bool)
    left[0] = False
    while left.any():
        d = ((c - c[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, d, np.inf).argmin()))
        left[order[-1]] = False
    return order


def blocks_of(sizes: np.ndarray, order: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each list, for blocks of about `rows` vectors."""
    first, parts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at, filled = 0, 0
    for c in order:
        if not sizes[c]:
            continue
        if filled and filled + sizes[c] > rows:
            at, filled = at + 1, 0
        first[c], parts[c] = at, -(-sizes[c] // rows)
        at, filled = (at, filled + sizes[c]) if parts[c] == 1 else (at + parts[c], 0)
    return first, parts


def learn(vectors: DataFrame, dim: int, n: int, threshold: float, rows_per_list: int) -> tuple[Lists, DataFrame]:
    """Lists and axes from a sample of at most SAMPLE_ROWS vectors, shells and blocks from all; the vectors with their list."""
    _, x = sample(vectors, SAMPLE_ROWS, dim)
    coarse = kmeans(x, max(1, min(MAX_LISTS, n // rows_per_list, len(x) // 8)))
    k = len(coarse)
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    between = np.stack([np.sqrt(((coarse.astype(np.float64) - c) ** 2).sum(1)) for c in coarse])
    lists = Lists(coarse, between, leading_axes(x, threshold), reach, np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64))
    shared = vectors.sparkSession.sparkContext.broadcast(lists)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = shared.value.distances(units(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d.argmin(1)), pa.array(d.min(1))], names=["vec_id", "v", "copies", "list", "far"])

    assigned = materialise(vectors.select("vec_id", "v", "copies").mapInArrow(assign, "vec_id long, v binary, copies long, list long, far double"))
    sizes = np.zeros(k, np.int64)
    for r in assigned.groupBy("list").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect():  # one row a list
        lists.lo[r["list"]], lists.hi[r["list"]], sizes[r["list"]] = r["lo"], r["hi"], r["n"]
    # at least so many blocks that all cores have tasks, more where their bytes ask for it
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n * dim * 4 // BLOCK_BYTES), min(ceil(sqrt(4 * cores)), -(-n // rows_per_list)))
    lists.first, lists.parts = blocks_of(sizes, chain(coarse), -(-n // blocks))
    return lists, assigned


def pairs_of(lists: Lists, threshold: float, raw: np.ndarray, home: np.ndarray, block: np.ndarray, low: int, high: int, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows of the task of blocks low and high, each pair once; of two blocks only pairs between them.

    A task of two blocks may have got rows of one alone, which then meet elsewhere. Where
    cosines needn't be exact, those of dense tiles are products of matrices in float32, and
    only what these can't decide is computed exactly.
    """
    dim = raw.shape[1]
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    which, place = np.unique(home, return_inverse=True)
    x32 = x.astype(np.float32)
    use = lists.partners(x32, home, which)
    lead = with_rest(x, lists.axes)
    two = low != high
    here, there = np.flatnonzero(block == low), np.flatnonzero(block == high)
    step, doubt = max(1, EXACT_BYTES // (8 * dim)), (dim + 8) * 6e-8  # more than float32 can be wrong by
    for c in np.unique(place[here]):
        rows = here[place[here] == c]
        # within a block a pair is looked for from the lesser list, in one list from the lesser row
        cols = there[use[there, c] & (two | (place[there] >= c))]
        cols = cols[use[rows].any(0)[place[cols]]]
        own = cols[place[cols] == c] if not two else cols[:0]
        cols = np.concatenate((own, cols[place[cols] != c] if not two else cols))
        left, right = lead[rows], lead[cols]
        for s in range(0, len(rows), TILE[0]):
            a = rows[s: s + TILE[0]]
            for t in range(int(np.searchsorted(own, a[0], side="right")), len(cols), TILE[1]):
                b = cols[t: t + TILE[1]]
                may = left[s: s + TILE[0]] @ right[t: t + TILE[1]].T >= np.float32(threshold - SLACK)
                if once := int(np.searchsorted(own[t: t + TILE[1]], a[-1], side="right")):
                    may[:, :once] &= b[:once] > a[:, None]
                if not exact and np.count_nonzero(may) > may.size * DENSE:
                    about = x32[a] @ x32[b].T
                    sure = may & (about >= np.float32(threshold + doubt))
                    may &= ~sure & (about >= np.float32(threshold - doubt))
                    if sure.any():
                        p, q = np.nonzero(sure)
                        yield a[p], b[q], about[sure]
                hit = np.flatnonzero(may)
                for e in range(0, len(hit), step):
                    p, q = a[hit[e: e + step] // len(b)], b[hit[e: e + step] % len(b)]
                    cosine = cosines(raw[p], raw[q])
                    good = cosine >= threshold
                    if good.any():
                        yield p[good], q[good], cosine[good]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, where each row has the least row of its component, after the pairs are added."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def all_pairs(pairs: Callable, ids: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """a, b, cosine to six decimals of each pair, a < b."""
    got = [(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.round(c, 6)) for i, j, c in pairs(exact=True)]
    return [np.concatenate(x) for x in zip(*got)] if got else [ids[:0], ids[:0], np.zeros(0)]


def all_links(pairs: Callable, ids: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """Of each row with partners in the task: id, the least id it is linked to there, number of partners with their copies."""
    label, links = np.arange(len(ids)), np.zeros(len(ids))
    for i, j, _ in pairs(exact=False):
        links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = joined(label, i, j)
    least = ids.copy()
    np.minimum.at(least, label, ids)
    some = links > 0
    return [ids[some], least[label[some]], links[some].astype(np.int64)]


def search(vectors: DataFrame, dim: int, threshold: float, rows_per_list: int | None, form: Callable, schema: str) -> DataFrame:
    """What `form` makes of the pairs of each task. vectors: vec_id, v, copies, as a written table."""
    spark = vectors.sparkSession
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    lists, assigned = learn(vectors, dim, n, threshold, rows_per_list or ROWS_PER_LIST)
    blocks = int((lists.first + lists.parts).max())
    shared = spark.sparkContext.broadcast(lists)

    def route(batches):
        known = shared.value
        member = np.zeros((len(known.first), blocks), np.float32)  # whether a list has vectors in a block
        for c, (first, parts) in enumerate(zip(known.first, known.parts)):
            member[c, first: first + parts] = 1
        for b in batches:
            for s in range(0, b.num_rows, ROUTED_ROWS):
                rows = b.slice(s, ROUTED_ROWS)
                home = rows.column(3).to_numpy()
                use = known.partners(units(rows.column(1), dim), home, np.arange(len(member)))
                own = known.block(rows.column(0).to_numpy(), home)
                row, other = np.nonzero(use.astype(np.float32) @ member > 0)
                task = np.minimum(own[row], other) * blocks + np.maximum(own[row], other)
                ends = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(own), pa.ListArray.from_arrays(pa.array(ends), pa.array(task))], names=["vec_id", "v", "copies", "list", "block", "tasks"])

    def meet(rows: pa.Table) -> pa.Table:
        ids, copies, home, block = (rows.column(name).to_numpy() for name in ("vec_id", "copies", "list", "block"))
        low, high = divmod(rows.column("task")[0].as_py(), blocks)
        pairs = partial(pairs_of, shared.value, threshold, matrix(rows.column("v"), dim), home, block, low, high)
        return pa.table(dict(zip(names, form(pairs, ids, copies))))

    names = [f.split()[0] for f in schema.split(", ")]
    routed = assigned.mapInArrow(route, "vec_id long, v binary, copies long, list long, block long, tasks array<long>").select(F.explode("tasks").alias("task"), "vec_id", "v", "copies", "list", "block")
    return routed.repartition(min(4_096, blocks * (blocks + 1) // 2), "task").groupBy("task").applyInArrow(meet, schema)


def near_pairs(table: DataFrame, threshold: float = THRESHOLD, rows_per_list: int | None = None) -> DataFrame:
    """(a, b, cosine to six decimals) of all pairs a < b with cosine at least threshold."""
    vectors, dim = usable_vectors(table)
    return search(materialise(vectors.withColumn("copies", F.lit(1).cast("long"))), dim, threshold, rows_per_list, all_pairs, RESULT)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, rows_per_list: int | None = None) -> DataFrame:
    """vec_id, group_id (the least vec_id of its group), duplicate, links (partners with cosine at least threshold): one row for each id."""
    found, dim = usable_vectors(table)
    vectors = materialise(found)
    nodes = materialise(vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "v", "copies"))
    linked = materialise(search(nodes, dim, threshold, rows_per_list, all_links, LINKED))
    partners = linked.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(linked, "vec_id", "least")
    of_node = nodes.select(F.col("vec_id").alias("node"), "copies").join(partners, "node", "left").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    copies = vectors.join(nodes.where("copies > 1").select("v", F.col("vec_id").alias("node")), "v").select("vec_id", "node")
    ids = table.select(table["vec_id"].cast("long").alias("vec_id"))
    known = ids.where("vec_id IS NOT NULL").distinct().join(copies, "vec_id", "left").select("vec_id", F.coalesce("node", "vec_id").alias("node")).join(of_node, "node", "left").select("vec_id", F.coalesce("group_id", "vec_id").alias("group_id"), "links")
    unknown = ids.where("vec_id IS NULL").select("vec_id", F.col("vec_id").alias("group_id"), F.lit(None).cast("long").alias("links"))
    return known.unionByName(unknown).select("vec_id", "group_id", F.coalesce(F.col("vec_id") != F.col("group_id"), F.lit(False)).alias("duplicate"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """All pairs by brute force in DuckDB."""
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT a, b, round(least(c, 1.0), 6) AS cosine FROM s WHERE c >= {threshold}"""


def groups_sql(threshold: float = THRESHOLD) -> str:
    """Groups and numbers of partners from all pairs by brute force in DuckDB."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) BETWEEN {threshold} AND 2),
r AS (SELECT vec_id AS node, vec_id AS root FROM e UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE s.b > r.root),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS links FROM s GROUP BY a)
SELECT g.node AS vec_id, g.root AS group_id, g.node <> g.root AS duplicate, coalesce(n.links, 0) AS links FROM g LEFT JOIN n ON n.a = g.node"""
