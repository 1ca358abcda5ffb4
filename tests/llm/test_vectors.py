import os

import numpy as np
import pytest

from skein.llm import ann, pq

SCHEMA = "vec_id long, embedding array<float>, label int, part int, slot int"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(a) for a in v], 0, 1, 2) for i, v in enumerate(x)] + list(extra), SCHEMA)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dim))
    x[n // 2: n // 2 + 40] = x[:40] + 0.01 * rng.normal(size=(40, dim))
    return x.astype(np.float32)


BAD = [(None, [1.0, 0.0], 0, 1, 2), (9001, None, 0, 1, 2), (9002, [], 0, 1, 2), (9003, [0.0] * 16, 0, 1, 2), (9004, [1.0], 0, 1, 2), (9005, [None] * 16, 0, 1, 2), (9006, [float("nan")] * 16, 0, 1, 2), (0, None, None, None, None)]


def cosine(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return u @ u.T


def test_neighbours_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PARTITION", 100)
    x = clustered(1500, 16, 1)
    s = cosine(x)
    np.fill_diagonal(s, -9)
    rows = ann.nearest(frame(spark, x, BAD), 5).collect()
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = {(r["query_id"], r["neighbour_id"]) for r in rows}
    assert len(rows) == len(got) == 5 * len(x)
    assert len(got & true) / len(true) >= 0.9
    for r in rows[:50]:
        assert abs(r["score"] - s[r["query_id"], r["neighbour_id"]]) < 1e-5


def test_partitions_are_balanced_and_cut_few_edges():
    x = clustered(1024, 8, 3)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = ann.top_k(u, u, 8, np.arange(len(u)))[0]
    label = ann.balanced_partition(graph, 8)
    assert np.bincount(label).tolist() == [128] * 8
    assert (label[graph] == label[:, None]).mean() > 0.6


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "ROWS_PER_LIST", 60)
    x = clustered(1500, 18, 2)
    extra = [(i, v, *r) for i, v, *r in BAD if v is None or len(v) != 16]
    rows = pq.near_pairs(frame(spark, x, extra)).collect()
    s = cosine(x)
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= pq.THRESHOLD, 1)))}
    assert {(r["a"], r["b"]) for r in rows} == true and len(rows) == len(true) >= 40


@pytest.mark.parametrize("data", [[], [(1, [1.0, 2.0], 0, 1, 2)], BAD])
def test_empty_and_tiny_tables(spark, data):
    t = spark.createDataFrame(data, SCHEMA)
    assert ann.nearest(t).count() == 0
    assert pq.near_pairs(t).count() == 0


def test_ties_and_repeated_rows(spark):
    t = frame(spark, [[1, 0], [1, 0], [1, 0], [0, 1]]).unionAll(frame(spark, [[1, 0]]))
    assert [(r["a"], r["b"]) for r in pq.near_pairs(t).orderBy("a", "b").collect()] == [(0, 1), (0, 2), (1, 2)]
    got = [(r["query_id"], r["rank"], r["neighbour_id"]) for r in ann.nearest(t, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]


def test_ties_of_many_equal_vectors_go_by_id(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(3, 8)), [50, 300, 30], axis=0).astype(np.float32)[rng.permutation(380)]
    s = cosine(x).round(12)
    np.fill_diagonal(s, -9)
    true = {(i, r, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:10], 1)}
    assert {(r["query_id"], r["rank"], r["neighbour_id"]) for r in ann.nearest(frame(spark, x)).collect()} == true


def test_cosines_closer_than_float32_are_told_apart(spark):
    x = np.zeros((60, 3), np.float32)
    x[:, 0], x[:, 1] = 1, 3e-4 - 1e-6 * np.arange(60)
    s = cosine(x)
    np.fill_diagonal(s, -9)
    got = {(r["query_id"], r["rank"], r["neighbour_id"]) for r in ann.nearest(frame(spark, x), 5).collect() if r["query_id"] == 0}
    assert got == {(0, r, int(j)) for r, j in enumerate(np.argsort(-s[0], kind="stable")[:5], 1)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_over_many_partitions_equal_their_sql(spark, sf):
    import duckdb

    from skein.llm import queries

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    for name in ("routed_neighbours_recall", "near_pairs_over_many_lists"):
        got = queries.queries()[name](spark, folder).toPandas()
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, db.execute(queries.oracle_sql()[name]).df()[list(got.columns)].to_numpy().tolist()))
        assert len(got)


def test_neighbours_over_two_levels_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_PARTITIONS", 4)
    x = clustered(1500, 16, 6)
    s = cosine(x)
    np.fill_diagonal(s, -9)
    found, dim = ann.usable_vectors(frame(spark, x))
    tree = ann.learn(found, dim, len(x), 5, 100)
    assert tree.width == 4 and sum(r is not None for r in tree.inner) == 4
    homes = tree.home(ann.units(found.toPandas()["v"], dim))
    assert len(set(homes.tolist())) > 8
    assert tree.outer_probes * tree.inner_probes < 16  # the table is clustered, so most partitions aren't probed
    rows = ann.nearest(frame(spark, x), 5, rows_per_partition=100).collect()
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = {(r["query_id"], r["neighbour_id"]) for r in rows}
    assert len(rows) == len(got) == 5 * len(x) and len(got & true) / len(true) >= 0.9


def test_fewest_probes_are_least_and_enough():
    rng = np.random.default_rng(2)
    outer, inner = rng.geometric(0.4, 400).clip(1, 6) - 1, rng.geometric(0.5, 400).clip(1, 5) - 1
    a, b = ann.fewest_probes(outer, inner, 6, 5, 0.9)
    share = lambda i, j: ((outer < i) & (inner < j)).mean()
    assert share(a, b) >= 0.9 and a * b == min(i * j for i in range(1, 7) for j in range(1, 6) if share(i, j) >= 0.9)


def clumps(sizes, dim, seed):
    """Vectors of which those of one clump have cosines of about .98, in random order."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dim))
    x = np.repeat(centres, sizes, axis=0)
    return (x + 0.14 * rng.normal(size=x.shape)).astype(np.float32)[rng.permutation(len(x))]


def groups_of(near):
    """(least row of its group, number of partners) of each row."""
    label, links = np.arange(len(near)), near.sum(1) - near.diagonal()
    while not np.array_equal(label, least := np.where(near | np.eye(len(near), dtype=bool), label, len(near)).min(1)):
        label = least
    return label.tolist(), links.tolist()


@pytest.mark.parametrize("block_bytes", [16 << 20, 4_000])  # the second cuts long lists into several blocks
def test_groups_and_links_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(pq, "ROWS_PER_LIST", 60)
    monkeypatch.setattr(pq, "BLOCK_BYTES", block_bytes)
    x = np.concatenate((clustered(600, 16, 2), clumps([200, 60, *[3] * 20, *[1] * 80], 16, 5)))
    lists, _ = pq.learn(pq.usable_vectors(frame(spark, x))[0].selectExpr("*", "1L AS copies"), 16, len(x), pq.THRESHOLD, 60)
    assert (lists.parts.max() > 1) == (block_bytes < 16 << 20) and (lists.first + lists.parts).max() > 3
    rows = {r["vec_id"]: r for r in pq.near_duplicates(frame(spark, x, [b for b in BAD if b[0] != 0])).collect() if r["vec_id"] is not None}
    group, links = groups_of(cosine(x) >= pq.THRESHOLD)
    assert [rows[i]["group_id"] for i in range(len(x))] == group and [rows[i]["links"] for i in range(len(x))] == links
    assert all(r["duplicate"] == (r["group_id"] != i) for i, r in rows.items())
    assert [(rows[i]["group_id"], rows[i]["links"]) for i in range(9001, 9007)] == [(i, 0) for i in range(9001, 9007)] and len(rows) == len(x) + 6


def test_groups_of_bad_empty_and_repeated_rows(spark):
    found = lambda t: sorted(map(tuple, pq.near_duplicates(t).collect()), key=repr)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0, 2.0], 0, 1, 2)], SCHEMA)) == [(1, 1, False, 0)]
    assert found(spark.createDataFrame(BAD, SCHEMA)) == [(0, 0, False, 0), *((i, i, False, 0) for i in range(9001, 9007)), (None, None, False, 0)]
    assert found(frame(spark, [[0, 1], [1, 0], [1, 0], [1, 0]]).unionAll(frame(spark, [[0, 1]]))) == [(0, 0, False, 0), (1, 1, False, 2), (2, 1, True, 2), (3, 1, True, 2)]


def test_large_groups_give_a_row_for_each_vector_as_sql_does(spark, tmp_path):
    import duckdb

    from skein.llm import queries

    x = clumps([150, 40, *[2] * 10, *[1] * 40], 24, 7)
    frame(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.queries()["op9_embedding_near_dedup"](spark, str(tmp_path)).toPandas()
    true = db.execute(queries.oracle_sql()["op9_embedding_near_dedup"]).df()
    assert len(got) == len(x) and got["links"].sum() > 20 * len(x)
    assert sorted(map(tuple, got[list(true.columns)].to_numpy().tolist())) == sorted(map(tuple, true.to_numpy().tolist()))


def test_tasks_give_no_more_rows_than_they_read(spark):
    x = clumps([400, 1, 1], 16, 8)
    vectors, dim = pq.usable_vectors(frame(spark, x))
    found = pq.search(pq.materialise(vectors.selectExpr("*", "1L AS copies")), dim, pq.THRESHOLD, 50, pq.all_links, pq.LINKED).collect()
    blocks = 8  # of 50 vectors; each meets itself and seven others
    assert 400 <= len(found) <= len(x) * 2 * blocks and sum(r["links"] for r in found) > 50 * len(found)


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("lists", [1, 5])
def test_every_pair_of_a_task_is_found_once(monkeypatch, two, lists, exact):
    monkeypatch.setattr(pq, "TILE", (32, 48))
    monkeypatch.setattr(pq, "EXACT_BYTES", 16 * 8 * 100)
    x = np.concatenate((clumps([90, 50, *[2] * 30], 16, 9), clustered(200, 16, 4))).astype(np.float64)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    coarse = u[:lists]
    between = np.sqrt(((coarse[:, None].astype(float) - coarse[None]) ** 2).sum(2))
    known = pq.Lists(coarse, between, pq.leading_axes(u, 0.95), np.sqrt(0.1) + pq.SLACK, np.full(lists, np.inf), np.full(lists, -np.inf), None, None)
    d = known.distances(u)
    home = d.argmin(1)
    for c in range(lists):
        known.lo[c], known.hi[c] = d[home == c, c].min(), d[home == c, c].max()
    block = np.arange(len(x)) % 2 if two else np.zeros(len(x), int)
    found = [(min(i, j), max(i, j)) for p, q, _ in pq.pairs_of(known, 0.95, x, home, block, 0, int(two), exact) for i, j in zip(p.tolist(), q.tolist())]
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cosine(x) >= 0.95, 1))) if not two or block[a] != block[b]}
    assert len(found) == len(set(found)) and set(found) == true and len(true) > 1000
    assert not list(pq.pairs_of(known, 0.95, x, home, np.zeros(len(x), int), 0, 1))  # rows of one block alone


def test_copies_count_as_partners_and_are_searched_as_one(spark, monkeypatch):
    searched, search = [], pq.search
    monkeypatch.setattr(pq, "search", lambda vectors, *rest: (searched.append(vectors.count()), search(vectors, *rest))[1])
    base = clumps([5, 2, *[1] * 6], 16, 11)
    x = np.repeat(base, [300, *[40, 1] * 6], axis=0)[np.random.default_rng(1).permutation(546)]
    rows = {r["vec_id"]: (r["group_id"], r["links"]) for r in pq.near_duplicates(frame(spark, x)).collect()}
    group, links = groups_of(cosine(x) >= pq.THRESHOLD)
    assert [rows[i] for i in range(len(x))] == list(zip(group, links)) and len(rows) == len(x)
    assert searched == [len(base)]


def test_cosines_at_the_threshold_are_decided_in_float64(spark):
    """Dense pairs whose cosines differ from the threshold by less than float32 tells."""
    angle = np.concatenate((np.zeros(1), np.arccos(0.95 + 1e-9 * np.arange(-200, 201))))
    x = np.stack((np.cos(angle), np.sin(angle), np.zeros(len(angle))), 1).astype(np.float32).astype(float)
    known = pq.Lists(np.zeros((1, 3), np.float32), np.zeros((1, 1)), np.eye(3)[:, :2], np.sqrt(0.1) + pq.SLACK, np.zeros(1), np.full(1, 2.0), None, None)
    zero = np.zeros(len(x), int)
    found = {(i, j) for p, q, _ in pq.pairs_of(known, 0.95, x, zero, zero, 0, 0, False) for i, j in zip(p.tolist(), q.tolist())}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cosine(x) >= 0.95, 1)))}
    assert 0 < sum(i == 0 for i, _ in found) < 401
