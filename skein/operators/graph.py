"""Graphs as edge tables: src, dst, weight.

Loops write each round's small table to the shared folder instead of growing a plan. Per-source
searches (betweenness, paths) broadcast the adjacency; their graphs are cluster graphs of at most
some thousand nodes, and `MAX_BROADCAST_EDGES` is checked before.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V
from skein.sources.storage import materialise

MAX_BROADCAST_EDGES = 5_000_000
LOCAL_EDGES = 200_000  # loops over so few edges run on the driver's arrays; more stay distributed


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, src < dst, with its greatest weight; loops are dropped."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def weighted_degree(neighbours: DataFrame) -> DataFrame:
    """Sum and mean of the scores of each source's neighbours, six decimals."""
    return neighbours.groupBy(F.col("src").alias("paper_id")).agg(F.round(F.sum("score"), 6).alias("degree"), F.round(F.avg("score"), 6).alias("mean_score"))


def topic_graph(centroids: DataFrame, k: int = 5, least: float = 0.15) -> DataFrame:
    """Clusters joined to their k most similar ones of cosine `least` or more; each pair once."""
    a, b = centroids.alias("a"), centroids.alias("b")
    pairs = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id")).select(F.col("a.cluster_id").alias("src"), F.col("b.cluster_id").alias("dst"), V.cosine(F.col("a.centroid"), F.col("b.centroid")).alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return undirected(pairs.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("weight") >= least)))


def _local(edges: DataFrame, nodes: DataFrame, weight: str):
    """(node ids, source places, target places, weights) as arrays; edges to unknown nodes are left out."""
    ids = np.array(sorted(r["node"] for r in nodes.collect()))
    e = edges.select("src", "dst", weight).toPandas()
    place = pd.Series(np.arange(len(ids)), index=ids)
    src, dst = place.reindex(e["src"]).to_numpy(), place.reindex(e["dst"]).to_numpy()
    good = ~(np.isnan(src.astype(float)) | np.isnan(dst.astype(float)))
    return ids, src[good].astype(int), dst[good].astype(int), e[weight].to_numpy(float)[good]


def _frame(nodes: DataFrame, ids, values, name: str) -> DataFrame:
    return nodes.sparkSession.createDataFrame(pd.DataFrame({"node": ids, name: values}), f"node {dict(nodes.dtypes)['node']}, {name} double")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 60, written: int = 10) -> DataFrame:
    """node, rank. Weights share a node's rank out; what dangling nodes hold isn't handed on."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = materialise(edges.join(total, "src").where("total > 0").groupBy("src", "dst").agg(F.sum(F.col("weight") / F.col("total")).alias("p")))
    nodes = materialise(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    if share.count() <= LOCAL_EDGES and n <= LOCAL_EDGES:
        ids, src, dst, p = _local(share, nodes, "p")
        r = np.full(n, 1.0 / n)
        for _ in range(rounds):
            r = (1 - damping) / n + damping * np.bincount(dst, weights=p * r[src], minlength=n)
        return _frame(nodes, ids, r, "rank")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        given = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("given"))
        rank = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if (i + 1) % written == 0:
            rank = materialise(rank)
    return rank


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 80, tolerance: float = 1e-6, written: int = 4) -> DataFrame:
    """node, centrality: power iteration over out-edges, norm 1 in each round, until it moves less than the tolerance.

    `written` rounds make one written table, whose scaling is left to the end, since the direction
    is the same; each of its rounds is tested, so it stops at the same one whatever their number.
    """
    edges = materialise(edges.select("src", "dst", F.greatest("weight", F.lit(0.0)).alias("weight")))
    nodes = materialise(nodes.select("node").distinct())
    n = nodes.count()
    if edges.count() <= LOCAL_EDGES and n <= LOCAL_EDGES:
        ids, src, dst, w = _local(edges, nodes, "weight")
        c = np.full(n, 1.0 / max(n, 1) ** 0.5)
        for _ in range(rounds):
            new = np.bincount(src, weights=w * c[dst], minlength=n)
            size = np.sqrt((new * new).sum())
            new = new / size if size > 0 else new
            done, c = np.abs(new - c).max(initial=0.0) < tolerance, new
            if done:
                break
        return _frame(nodes, ids, c, "centrality")
    known = lambda c: nodes.select(F.col("node").alias(c))
    edges = materialise(edges.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi"))
    v = nodes.withColumn("c0", F.lit(1.0 / max(n, 1) ** 0.5))
    for at in range(0, rounds, written):
        u, t, steps = v, v, min(written, rounds - at)
        for j in range(1, steps + 1):
            u = edges.join(u.select(F.col("node").alias("dst"), F.col(f"c{j - 1}").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("c")).alias(f"c{j}"))
            t = t.join(u, "node", "left")
        t = materialise(t.na.fill(0.0))
        size = [x or 1.0 for x in t.agg(*[F.sqrt(F.sum(F.col(f"c{j}") * F.col(f"c{j}"))) for j in range(steps + 1)]).first()]
        unit = lambda j: F.col(f"c{j}") / size[j]
        moved = t.agg(*[F.max(F.abs(unit(j) - unit(j - 1))) for j in range(1, steps + 1)]).first()
        done = next((j for j, m in enumerate(moved, 1) if m is None or m < tolerance), None)
        v = t.select("node", unit(done or steps).alias("c0"))
        if done:
            break
    return v.withColumnRenamed("c0", "centrality")


def _stars(edges: DataFrame) -> DataFrame:
    """u, v: each node of few edges with the least node it is linked to, roots left out."""
    e = edges.toPandas()
    ids, place = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]) if len(e) else np.zeros(0, np.int64), return_inverse=True)
    a, b, label = place[: len(e)], place[len(e):], np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return edges.sparkSession.createDataFrame(pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]}), edges.schema)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node), by alternating large and small stars.

    Each round hangs every node's greater neighbours on its least neighbour, then its lesser
    neighbours on the least of them; edges never get more, and the rounds grow with the
    logarithm of the number of nodes. It is done when a round changes no edge, which is
    compared by the edges' count and sum of hashes. Up to LOCAL_EDGES edges are labelled on
    the driver, with the same result.
    """
    low = lambda a, b: F.least(a, b)
    now = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), low("src", "dst").alias("v")).distinct())
    before, few = None, now.count() <= LOCAL_EDGES
    if few:
        now = _stars(now)
    while not few:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # large star: x's neighbours above it go to the least of x and its neighbours
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), low("m", "x").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours go to the least of them
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.col("v").alias("a"), F.col("u").alias("b"), "m")
        now = materialise(small.select(F.explode(F.array("a", "b")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def oriented(e: DataFrame, degree: DataFrame) -> DataFrame:
    """Undirected edges turned to go from the end of lesser degree, of equal ones the lesser node."""
    d = lambda c: degree.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}"))
    j = e.join(d("src"), "src").join(d("dst"), "dst")
    right = (F.col("dsrc") < F.col("ddst")) | ((F.col("dsrc") == F.col("ddst")) & (F.col("src") < F.col("dst")))
    return j.select(F.when(right, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(right, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """node, degree, clustering: share of a node's neighbour pairs that are joined."""
    e = materialise(undirected(edges.withColumn("weight", F.lit(1.0))).select("src", "dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    # edges go from the end of lesser degree, so that a hub starts few paths; each triangle is found once, at its first corner
    up = oriented(e, degree)
    t = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").where("a < b").join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"])
    corner = t.select(F.explode(F.array("src", "a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = F.col("degree")
    return degree.join(corner, "node", "left").select("node", "degree", F.when(d >= 2, 2 * F.coalesce("triangles", F.lit(0)) / F.nullif(d * (d - 1), F.lit(0))).otherwise(0.0).alias("clustering"))


def structural_holes(edges: DataFrame) -> DataFrame:
    """node, constraint, effective_size, from each node's shares of its undirected weight."""
    once = materialise(undirected(edges))
    both = both_ways(once)
    total = both.groupBy("src").agg(F.sum("weight").alias("total"), F.count("*").alias("degree"))
    p = materialise(both.join(total, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    # only paths of two edges that close a triangle count, so triangles are listed first, from their corner of least degree
    up = oriented(once.select("src", "dst"), total.select(F.col("src").alias("node"), "degree"))
    t = up.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(up.select(F.col("src").alias("x"), F.col("dst").alias("z")), "x").where("y < z").join(once.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    turns = F.array(*[F.struct(F.col(a).alias("src"), F.col(q).alias("q"), F.col(b).alias("dst")) for a, q, b in (("x", "y", "z"), ("z", "y", "x"), ("x", "z", "y"), ("y", "z", "x"), ("y", "x", "z"), ("z", "x", "y"))])
    via = t.select(F.explode(turns).alias("w")).select("w.*")
    steps = via.join(p.select("src", F.col("dst").alias("q"), F.col("p").alias("p1")), ["src", "q"]).join(p.select(F.col("src").alias("q"), "dst", F.col("p").alias("p2")), ["q", "dst"])
    indirect = steps.groupBy("src", "dst").agg(F.sum(F.col("p1") * F.col("p2")).alias("i"))
    each = p.join(indirect, ["src", "dst"], "left").withColumn("i", F.coalesce("i", F.lit(0.0)))
    return each.groupBy(F.col("src").alias("node")).agg(F.sum((F.col("p") + F.col("i")) ** 2).alias("constraint"), F.sum(1 - F.col("i")).alias("effective_size"))


def betweenness(edges: DataFrame, weighted: bool = False, normalization: str = "reference") -> DataFrame:
    """node, betweenness by Brandes' accumulation, sources in parallel.

    Unweighted: 'reference' counts each pair in both directions and scales by 2 / ((n-1)(n-2)),
    twice the usual value; 'standard' is the usual one. Weighted: weights are lengths, each pair
    once, not scaled.
    """
    e = undirected(edges) if not weighted else edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    e = materialise(e)  # once, not for the count and again for the edges
    count = e.count()
    if count > MAX_BROADCAST_EDGES:
        raise ValueError(f"{count} edges are too many to broadcast for betweenness")
    adjacency: dict = {}
    for r in e.collect():
        adjacency.setdefault(r["src"], []).append((r["dst"], r["weight"]))
        adjacency.setdefault(r["dst"], []).append((r["src"], r["weight"]))
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    if not adjacency:
        return spark.createDataFrame([], f"node {kind}, betweenness double")
    shared = spark.sparkContext.broadcast(adjacency)

    def from_sources(batches):
        graph = shared.value
        score = dict.fromkeys(graph, 0.0)
        for b in batches:
            for s in b["node"].tolist():
                _accumulate(graph, s, weighted, score)
        yield pd.DataFrame({"node": list(score), "part": list(score.values())})

    sources = spark.createDataFrame([(n,) for n in sorted(adjacency)], f"node {kind}").repartition(spark.sparkContext.defaultParallelism)
    n = len(adjacency)
    if weighted:
        scale = 0.5
    else:
        scale = (2.0 if normalization == "reference" else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return sources.mapInPandas(from_sources, f"node {kind}, part double").groupBy("node").agg((F.sum("part") * scale).alias("betweenness"))


def _accumulate(graph: dict, s, weighted: bool, score: dict) -> None:
    dist, paths, before, order = {s: 0.0}, {s: 1.0}, {}, []
    done, heap, tick = set(), [(0.0, 0, s)], 0
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w, length in graph[v]:
            new = d + (length if weighted else 1.0)
            old = dist.get(w)
            if old is None or new < old - 1e-12:
                dist[w], paths[w], before[w] = new, paths[v], [v]
                tick += 1
                heapq.heappush(heap, (new, tick, w))
            elif abs(new - old) <= 1e-12 and w not in done:
                paths[w] += paths[v]
                before[w].append(v)
    credit = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before.get(w, ()):
            credit[v] += paths[v] / paths[w] * (1 + credit[w])
        if w != s:
            score[w] += credit[w]


def bridging(edges: DataFrame) -> DataFrame:
    """betweenness * (1 - clustering) with both parts, per node."""
    return betweenness(edges).join(local_clustering(edges), "node").withColumn("bridging", F.col("betweenness") * (1 - F.col("clustering")))


def recombination(neighbours: DataFrame, papers: DataFrame, top: int = 3) -> DataFrame:
    """Entropy of the clusters of a paper's neighbours over ln of the number of clusters; the top ones."""
    clusters = papers.where("cluster_id IS NOT NULL").agg(F.countDistinct("cluster_id").alias("k"))
    c = neighbours.join(papers.select(F.col("paper_id").alias("dst"), "cluster_id"), "dst").where("cluster_id IS NOT NULL").groupBy("src", "cluster_id").agg(F.count("*").alias("n"))
    per = Window.partitionBy("src")
    w = per.orderBy(F.desc("n"), "cluster_id")
    shares = c.select("src", "cluster_id", (F.col("n") / F.sum("n").over(per)).alias("p"), F.row_number().over(w).alias("r"))
    out = shares.groupBy("src").agg(F.sum(-F.col("p") * F.ln(F.col("p") + 1e-12)).alias("h"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "cluster_id")))), lambda s: s["cluster_id"]).alias("top_clusters"))
    return out.crossJoin(F.broadcast(clusters)).select(F.col("src").alias("paper_id"), (F.col("h") / F.ln(F.greatest(F.lit(2), "k"))).alias("recombination"), "top_clusters")


def cluster_edges(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Paper edges summed between clusters."""
    of = lambda n: papers.select(F.col("paper_id").alias(n), F.col("cluster_id").alias(f"{n}_cluster"))
    return edges.join(of("src"), "src").join(of("dst"), "dst").groupBy("src_cluster", "dst_cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def reachable(edges: DataFrame, sources: DataFrame, max_hops: int = 6) -> DataFrame:
    """node, hops, via: breadth-first distance from a set of nodes, and the least predecessor.

    One join per hop; nodes already reached are left out of the frontier.
    """
    edges = materialise(edges.select("src", "dst"))  # once, not for each hop
    seen = materialise(sources.select(F.col("node"), F.lit(0).alias("hops"), F.lit(None).cast(dict(sources.dtypes)["node"]).alias("via")).distinct())
    front = seen
    for hop in range(1, max_hops + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        front = materialise(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "via"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6) -> list:
    """The nodes of a shortest path from any source to any target, [] without one."""
    found = reachable(edges, sources, max_hops)
    end = found.join(targets.select("node").distinct(), "node").orderBy("hops", "node").first()
    out = []
    while end is not None:  # at most max_hops lookups
        out.append(end["node"])
        end = found.where(F.col("node") == end["via"]).first() if end["via"] is not None else None
    return out[::-1]


def claim_path(edges: DataFrame, claims: DataFrame, source, target, max_hops: int = 6) -> list:
    """The claims of a shortest path from any claim of one cluster to any of another."""
    of = lambda c: claims.where(F.col("cluster_id") == F.lit(c)).select(F.col("claim_id").alias("node"))
    return path(edges, of(source), of(target), max_hops)


def idea_river(edges: DataFrame, start, hops: int = 5, nodes: DataFrame | None = None, years: tuple[int, int] | None = None) -> list:
    """From a start, the heaviest edge to a node not yet visited, up to `hops` times; years: only nodes (node, year) within them."""
    if years is not None:
        inside = nodes.where(F.col("year").between(*years)).select(F.col("node").alias("dst"))
        edges = edges.join(inside, "dst", "left_semi")
    edges = materialise(edges.select("src", "dst", "weight"))
    out = [start]
    for _ in range(hops):
        r = edges.where((F.col("src") == out[-1]) & ~F.col("dst").isin(out)).orderBy(F.desc("weight"), "dst").first()
        if r is None:
            break
        out.append(r["dst"])
    return out


def citation_metrics(cites: DataFrame, nodes: DataFrame) -> DataFrame:
    """paper_id, in_degree, out_degree, rank: of an edge table src, dst, weight (match score)."""
    into = cites.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = cites.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    base = nodes.select("node").distinct().join(pagerank(cites, nodes), "node")
    return base.join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "rank")


def coupling(cites: DataFrame, limit: int = 120) -> DataFrame:
    """Pairs that cite the same papers, by how many."""
    a = cites.select(F.col("src").alias("a"), "dst")
    b = cites.select(F.col("src").alias("b"), "dst")
    return a.join(b, "dst").where("a < b").groupBy("a", "b").agg(F.countDistinct("dst").alias("shared")).orderBy(F.desc("shared"), "a", "b").limit(limit)


def co_citation(cites: DataFrame, limit: int = 120) -> DataFrame:
    """Pairs cited together, by how often."""
    return coupling(cites.select(F.col("dst").alias("src"), F.col("src").alias("dst")), limit)
