"""Operator 7, SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: the signs of the sums of the hashed bits of a text's distinct
lower-case words, each weighted by the square root of its count. Two texts are near
duplicates if their fingerprints differ in at most `TAU` bits and the Jaccard similarity
of their word triples, estimated from bottom-`SKETCH` sketches, is at least `SIMILAR`.

Search: bits that are correlated over all fingerprints are grouped into the same
partition. A pair within TAU bits differs in at most t_i bits of some partition i, for any
thresholds with sum(t_i + 1) = TAU + 1; dynamic programming picks the thresholds, and the
number of partitions, with the fewest probes and candidates, estimated from the histograms
of all fingerprints' partition values. Every fingerprint then probes each partition with
all values within t_i bits of its own (each pair from one side only) and candidates are
verified on all 64 bits. This finds every pair; thresholds only move the cost. To bring a
fingerprint and its probes together, a partition is again cut by the pigeonhole principle:
values within t_i bits agree on at least one of t_i + 1 blocks of its bits, so what is
shuffled is one row for each block, not for each probe. Texts with equal fingerprint and
sketch are one node, so thousands of copies cost no more than one text.

Groups are the connected components of the pairs; the least doc_id stands for its group.

Defined results: a text without words (null, empty, only symbols) is no duplicate of
anything: it is its own group. A row with null doc_id can't be named: group null, not a
duplicate. Rows with equal doc_id and equal text are one document. Other columns of docs
are ignored (`near_duplicates`) or kept (`deduplicate`).
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import map_texts, materialise, quoted, slices, text_buffers, unused
from skein.llm.components import components
from skein.llm.tokens import mix, sum_rows, words

BITS, TAU = 64, 10
SKETCH, SIMILAR = 48, 0.35
PARTITIONS = (4, 5, 6, 8)
MAX_RADIUS = 3
SLICE_BYTES = 1 << 20
BROADCAST_IDS = 4_000_000  # up to so many ids go to every task, more are joined by shuffling documents
PROBE_COST = 40  # of one probe, in verified candidates
BUCKET_ROWS = 1 << 18  # fingerprints in a bucket; more bits go into the keys beyond
TASK_ROWS, CANDIDATES = 1 << 20, 1 << 20  # fingerprints a task holds, candidates at once


def fingerprints(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, has words) of each text."""
    h, rows, _ = words(offsets, raw, fold=True)
    n = len(offsets) - 1
    key = (rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    first = np.searchsorted(key >> np.uint64(44), np.arange(n + 1, dtype=np.uint64))
    weight = np.rint(16 * np.sqrt(counts)).astype(np.int32)
    feature = mix(key & np.uint64((1 << 44) - 1))
    ones = np.unpackbits(feature.view(np.uint8).reshape(-1, 8), axis=1)
    sums = sum_rows(ones * weight[:, None], first)
    total = sum_rows(weight, first)
    bits = 2 * sums > total[:, None]
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64), first[1:] > first[:-1]


def sketches(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the SKETCH least hashes of each text's distinct word triples.

    A text of one or two words has one shingle: all of it.
    """
    h, rows, first = words(offsets, raw, fold=True)
    n, size = len(offsets) - 1, np.diff(first)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    nxt = lambda d: np.concatenate((h[d:], np.zeros(min(d, len(h)), np.uint64)))
    place = np.arange(len(h)) - first[rows] if len(h) else np.zeros(0, np.int64)
    left = size[rows] - place
    shingle = h * a + np.where(left > 1, nxt(1), np.uint64(0)) * b + np.where(left > 2, nxt(2), np.uint64(0)) * c
    use = (left > 2) | (place == 0)
    key = (rows[use].astype(np.uint64) << np.uint64(32)) | (mix(shingle[use]) >> np.uint64(33))
    key = np.unique(key)
    row = (key >> np.uint64(32)).astype(np.int64)
    start = np.searchsorted(row, np.arange(n + 1))
    keep = np.arange(len(key)) - start[row] < SKETCH if len(key) else np.zeros(0, bool)
    values = (key[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return values, np.concatenate(([0], np.cumsum(np.minimum(np.diff(start), SKETCH))))


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp (null without words), sketch for every row."""

    def run(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column(1))
            for i, j in slices(off, SLICE_BYTES):
                o, r = off[i: j + 1] - off[i], raw[off[i]: off[j]]
                fp, known = fingerprints(o, r)
                values, first = sketches(o, r)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp, mask=~known), lists], names=["doc_id", "fp", "sketch"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, fp long, sketch array<int>")


def bit_order(fps: DataFrame) -> np.ndarray:
    """Bits in an order that puts correlated ones next to each other, from all fingerprints."""

    def moments(batches):
        total, outer, n = np.zeros(BITS), np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += x.sum(axis=0)
            outer += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([n], total, outer.reshape(-1))).tobytes()], pa.binary())], names=["m"])

    parts = [np.frombuffer(r["m"], np.float64) for r in fps.select("fp").mapInArrow(moments, "m binary").collect()]
    m = np.sum(parts, axis=0) if parts else np.zeros(1 + BITS + BITS * BITS)
    n = max(1.0, m[0])
    mean, outer = m[1: BITS + 1] / n, m[BITS + 1:].reshape(BITS, BITS) / n
    cov = outer - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    order = [int(np.unravel_index(corr.argmax(), corr.shape)[0])]
    while len(order) < BITS:  # the bit most correlated with the last few
        score = corr[order[-8:]].mean(axis=0)
        score[order] = -2
        order.append(int(score.argmax()))
    return np.array(order)


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def widths_of(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def permute(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1)[:, order]
    return np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)


def part_value(p: np.ndarray, widths: list[int], i: int) -> np.ndarray:
    """Partition i of permuted fingerprints; partitions go from the highest bits down."""
    return (p >> np.uint64(BITS - sum(widths[: i + 1]))) & np.uint64((1 << widths[i]) - 1)


def choose_thresholds(histograms: dict[int, list[np.ndarray]], n: int, tau: int = TAU) -> tuple[list[int], list[int]]:
    """(widths, thresholds) with the least estimated cost; a threshold of -1 skips a partition."""
    best = None
    for m, hists in histograms.items():
        widths = widths_of(m)
        cost = np.full((m, MAX_RADIUS + 2), 0.0)
        for i, hist in enumerate(hists):
            value = np.arange(len(hist))
            # pairs at each distance: spread the histogram bit by bit
            layers = [hist.astype(np.float64)] + [np.zeros(len(hist)) for _ in range(MAX_RADIUS)]
            for bit in range(widths[i]):
                flip = value ^ (1 << bit)
                for r in range(MAX_RADIUS, 0, -1):
                    layers[r] = layers[r] + layers[r - 1][flip]
            pairs = 0.0
            for t in range(MAX_RADIUS + 1):
                pairs += float((hist * layers[t]).sum()) / 2
                cost[i, t + 1] = pairs + PROBE_COST * n * len(ball(widths[i], t)) / 2
        need = tau + 1
        table = {0: (0.0, [])}
        for i in range(m):
            new = {}
            for used, (c, ts) in table.items():
                for t in range(-1, min(MAX_RADIUS, widths[i]) + 1):
                    u = min(need, used + t + 1)
                    if u not in new or c + cost[i, t + 1] < new[u][0]:
                        new[u] = (c + cost[i, t + 1], [*ts, t])
            table = new
        if need in table and (best is None or table[need][0] < best[0]):
            best = (table[need][0], widths, table[need][1])
    return best[1], best[2]


def covers(width: int, radius: int, blocks: int) -> list[tuple[int, list[int]]]:
    """(key, masks): bits of a partition and the masks that leave them alone.

    The partition is cut into blocks; a mask of at most radius bits leaves at least
    blocks - radius of them alone, so each belongs to some choice of so many: the first.
    """
    edges = [width * b // blocks for b in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    left, out = ball(width, radius), []
    for some in combinations(block, blocks - radius):
        key = sum(some)
        out.append((key, [m for m in left if not m & key]))
        left = [m for m in left if m & key]
    return [(key, masks) for key, masks in out if masks]


def fitting_covers(hist: np.ndarray, width: int, radius: int) -> list[tuple[int, list[int]]]:
    """The covers with the fewest keys whose buckets hold at most BUCKET_ROWS fingerprints.

    A value so frequent that no key can part it sets the least size.
    """
    value = np.arange(len(hist))
    limit = max(BUCKET_ROWS, 2 * int(hist.max()))
    for blocks in range(radius + 1, width + 1):
        found = covers(width, radius, blocks)
        if all(np.bincount(value & key, weights=hist).max() <= limit for key, _ in found):
            break
    return found


def partition_histograms(nodes: DataFrame, order: np.ndarray) -> dict[int, list[np.ndarray]]:
    """For each number of partitions, how many fingerprints have each value of each partition."""

    def count(batches):
        hists = {(m, i): np.zeros(1 << w, np.int64) for m in PARTITIONS for i, w in enumerate(widths_of(m))}
        for b in batches:
            p = permute(b.column(0).to_numpy(), order)
            for (m, i), h in hists.items():
                h += np.bincount(part_value(p, widths_of(m), i).astype(np.int64), minlength=len(h))
        for (m, i), h in hists.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m * 100 + i)), pa.array(at), pa.array(h[at])], names=["part", "value", "n"])

    hists = {m: [np.zeros(1 << w, np.int64) for w in widths_of(m)] for m in PARTITIONS}
    counted = nodes.select("fp").mapInArrow(count, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most 2^16 values in each of 23 partitions
    for part, rows in got.groupby("part"):
        hists[part // 100][part % 100][rows["value"].to_numpy()] = rows["n"].to_numpy()
    return hists


def value_pairs(v: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, size): for rows in order of v, the later rows whose value is v ^ mask, if that is greater."""
    n = len(v)
    row = np.arange(n)
    if not mask:
        first, last = row + 1, np.searchsorted(v, v, side="right")
    else:
        row = np.flatnonzero((v ^ mask) > v)
        other = v[row] ^ mask
        first, last = np.searchsorted(v, other), np.searchsorted(v, other, side="right")
    some = last > first
    return row[some], first[some], (last - first)[some]


def close_rows(p: np.ndarray, v: np.ndarray, masks: list[int], tau: int):
    """(i, j) of the rows, sorted by v, whose values differ by one of the masks and which differ in at most tau bits."""
    for mask in masks:
        row, first, size = value_pairs(v, mask)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(row):  # about CANDIDATES at once
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, side="right")))
            some = size[lo:hi]
            i = np.repeat(row[lo:hi], some)
            j = np.arange(len(i)) + np.repeat(first[lo:hi] - (ends[lo:hi] - some - (ends[lo - 1] if lo else 0)), some)
            near = np.flatnonzero(np.bitwise_count(p[i] ^ p[j]) <= tau)
            yield i[near], j[near]
            lo = hi


def node_pairs(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): all pairs of nodes a < b whose fingerprints differ in at most tau bits, once each.

    nodes: fp, node. Each fingerprint goes to one bucket for each key of its partitions'
    covers, not to one for each mask; the masks are tried inside the buckets. A pair is
    given by the first partition that admits it.
    """
    order = bit_order(nodes)
    hists = partition_histograms(nodes, order)
    n = int(hists[PARTITIONS[0]][0].sum())
    widths, thresholds = choose_thresholds(hists, n, tau)
    used = [i for i, t in enumerate(thresholds) if t >= 0]
    shifts = [BITS - sum(widths[: i + 1]) for i in range(len(widths))]
    plan = [(i, key, masks) for i in used for key, masks in fitting_covers(hists[len(widths)][i], widths[i], thresholds[i])]

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permute(b.column(0).to_numpy(), order).view(np.int64)), b.column(1)], names=["p", "node"])

    def search(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        bucket, p_all, node_all = map(np.concatenate, zip(*got))
        p_all, cover = p_all.view(np.uint64), bucket >> 20
        for c in np.unique(cover):
            i, _, masks = plan[c]
            mine = np.flatnonzero(cover == c)
            v = part_value(p_all[mine], widths, i).astype(np.int64)
            sort = np.argsort(v, kind="stable")
            v, p, node = v[sort], p_all[mine[sort]], node_all[mine[sort]]
            for x, y in close_rows(p, v, masks, tau):
                differ, new = p[x] ^ p[y], np.ones(len(x), bool)
                for j in used[: used.index(i)]:
                    new &= np.bitwise_count(part_value(differ, widths, j)) > thresholds[j]
                a, b = node[x[new]], node[y[new]]
                new = a != b
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[new]), pa.array(np.maximum(a, b)[new])], names=["a", "b"])

    keys = [(F.shiftrightunsigned("p", shifts[i]).bitwiseAND(key) + F.lit(c << 20)).cast("int") for c, (i, key, _) in enumerate(plan)]
    buckets = nodes.select("fp", "node").mapInArrow(place, "p long, node long").select(F.explode(F.array(*keys)).alias("bucket"), "p", "node")
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(plan) // TASK_ROWS))
    return buckets.repartition(tasks, "bucket").mapInArrow(search, "a long, b long")


def candidate_pairs(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """(p, q): all pairs of distinct fingerprints within tau bits, p < q. fps: column fp, distinct."""
    return node_pairs(fps.select("fp", F.col("fp").alias("node")), tau).select(F.col("a").alias("p"), F.col("b").alias("q"))


def similarity(a, b):
    """Jaccard similarity estimated from two sorted bottom-k sketches; exact if both are short."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.greatest(F.size(union), F.lit(1))


def checked(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast where they are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified_edges(table: DataFrame, nodes: DataFrame, similar: float, tau: int = TAU) -> DataFrame:
    """(a, b): node pairs with near fingerprints and similar sketches, enough of them to link every group.

    table: doc_id, fp, sig, sketch; nodes: fp, sig, node. In a group of thousands nearly all
    pairs are candidates, but its components need few of them: first each node is verified
    against its least neighbour only, then, of all candidates, those that these edges don't
    already connect. Only the sketches of nodes that have a candidate are moved.
    """
    near = materialise(node_pairs(nodes, tau))
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select(F.col("node").alias("doc_id"), "fp", "sig")
    keys = ["doc_id", "fp", "sig"]
    sketch = materialise(table.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.first("sketch").alias("sketch")).select(F.col("doc_id").alias("node"), "sketch"))

    def verify(some: DataFrame) -> DataFrame:
        left = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
        right = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
        return some.join(left, "a").join(right, "b").where(similarity(F.col("sa"), F.col("sb")) >= similar).select("a", "b")

    first = materialise(verify(near.groupBy("b").agg(F.min("a").alias("a"))))
    linked = components(first)
    of = lambda x: linked.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = near.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    return first.unionByName(verify(rest.select("a", "b")))


def near_duplicates(docs: DataFrame, tau: int = TAU, similar: float = SIMILAR) -> DataFrame:
    """doc_id, group_id (the least doc_id of its group), duplicate, for every row."""
    table = materialise(sketch_table(docs).withColumn("sig", F.xxhash64("sketch")))
    named = table.where("doc_id IS NOT NULL AND fp IS NOT NULL")
    nodes = materialise(named.groupBy("fp", "sig").agg(F.min("doc_id").alias("node")))
    groups = components(verified_edges(named, nodes, similar, tau))
    node_of = named.select("doc_id", "fp", "sig").join(nodes, ["fp", "sig"]).join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("group_id"))
    rest = table.where("doc_id IS NULL OR fp IS NULL").select("doc_id", F.col("doc_id").alias("group_id"))
    return node_of.unionByName(rest).select("doc_id", "group_id", F.coalesce(F.col("doc_id") != F.col("group_id"), F.lit(False)).alias("duplicate"))


def deduplicate(docs: DataFrame, tau: int = TAU, similar: float = SIMILAR) -> DataFrame:
    """docs without the duplicates: one row of each group, columns unchanged.

    A doc_id goes if all its rows are duplicates. Of rows with equal doc_id and text one
    stays, the first by its JSON; rows with null doc_id all stay. Columns may have any names.
    """
    found = materialise(near_duplicates(docs, tau, similar))
    counts = materialise(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("duplicate").alias("duplicate")).where("duplicate OR rows > 1"))
    names, id_name, row_name = quoted(docs.columns), unused(docs, "id"), unused(docs, "row")
    ids = lambda condition: counts.where(condition).select(F.col("doc_id").alias(id_name))
    on = F.col("doc_id").cast("long") == F.col(id_name)
    # a few ids go to every task, then no text is shuffled
    stay = docs.join(checked(ids("duplicate")), on, "left_anti")
    again = ids("NOT duplicate")
    if again.isEmpty():
        return stay.select(names)
    first = Window.partitionBy(F.col("doc_id").cast("long"), "text").orderBy(F.to_json(F.struct(*names)))
    one = stay.join(checked(again), on, "left_semi").withColumn(row_name, F.row_number().over(first)).where(F.col(row_name) == 1)
    return stay.join(checked(again), on, "left_anti").select(names).unionByName(one.select(names))
