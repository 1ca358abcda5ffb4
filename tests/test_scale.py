"""Results of steps that were rewritten to hold at size, against plain forms of the same."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import plans
from skein.operators import claims, graph, hygiene, knn, novelty

SF = "/root/testdata/sf0.001"


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def typed(spark):
    rng, rows = np.random.default_rng(5), []
    words = ["we improve", "it does not hold", "it extends", "we fail to improve", "a test", "further improves", None]
    for i in range(120):
        metrics = None if i % 11 == 0 else [None if m == 9 else f"m{m}" for m in rng.integers(0, 10, rng.integers(0, 5))]
        rows.append((f"c{i}", int(rng.integers(0, 9)), [None, "x", "y", "z"][rng.integers(0, 4)], words[rng.integers(0, 7)], None if rng.random() < 0.3 else f"d{rng.integers(0, 12)}", metrics))
    return spark.createDataFrame(rows, "claim_id string, paper_id int, cluster_id string, statement string, dataset string, metrics array<string>").cache()


def plain_relations(rows):
    """All pairs, one after another."""
    out = {}
    for a in rows:
        for b in rows:
            shared = {m for m in a.metrics or () if m is not None} & set(b.metrics or ())
            if a.claim_id != b.claim_id and ((a.dataset is not None and a.dataset == b.dataset) or shared):
                s, t = (a.statement or "").lower(), (b.statement or "").lower()
                denies, extends = "does not" in t or "fail" in t, any(w in t for w in ("extends", "builds on", "further improves"))
                out[a.claim_id, b.claim_id] = "contradicts" if "improve" in s and denies else "extends" if extends else "supports" if "improve" in s and "improve" in t else "comparesTo"
    return out


def test_claim_relations_come_once_and_without_a_shuffle_of_pairs(spark, typed):
    got = claims.relations(typed)
    rows = got.collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows) and {(r.src, r.dst): r.kind for r in rows} == plain_relations(typed.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan


def test_edge_controversy_is_counted_without_pairs(spark, typed):
    assert bag(claims.relation_controversy(typed).select(*sorted(["cluster_id", "supports", "contradicts", "compares", "cross_contradicts", "diversity"]))) == bag(claims.edge_controversy(claims.relations(typed), typed).select(*sorted(["cluster_id", "supports", "contradicts", "compares", "cross_contradicts", "diversity"])))
    single = typed.withColumn("metrics", F.slice("metrics", 1, 1)).where("statement IS NOT NULL")
    assert bag(claims.relation_controversy(single).select("cluster_id", "supports", "cross_contradicts")) == bag(claims.edge_controversy(claims.relations(single), single).select("cluster_id", "supports", "cross_contradicts"))


def test_edge_controversy_where_no_table_is_small(spark, typed, monkeypatch):
    few = bag(claims.relation_controversy(typed))
    monkeypatch.setattr(claims, "BROADCAST_ROWS", -1)
    assert bag(claims.relation_controversy(typed)) == few


def plain_knn(rows, k, within=False):
    """By all pairs in order, ties to the lesser id."""
    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return min(1.0, max(-1.0, sum(x * y for x, y in zip(a, b)) / size)) if size else 0.0

    out = {}
    for i, c, x in rows:
        near = sorted((-cosine(x, y), j) for j, e, y in rows if j != i and (not within or e == c))[:k]
        out |= {(i, j): (r, round(-s, 9)) for r, (s, j) in enumerate(near, 1)}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)).astype(np.float32).astype(float)
    x[10:30] = x[40]  # equal vectors, so that ties go across blocks and parts
    x[50] = 0
    return [(int(i), int(i) % 4, v.tolist()) for i, v in zip(rng.permutation(90), x)]


@pytest.mark.parametrize("block,rows", [(4_096, 8_192), (7, 8_192), (7, 5)])
def test_neighbours_with_ties_are_exact_in_all_parts(spark, vectors, monkeypatch, block, rows):
    if block < 100:
        monkeypatch.setattr(knn, "MATRIX_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn, "TASK_ROWS", rows)
    p = spark.createDataFrame(vectors, "paper_id long, cluster_id int, embedding array<float>")
    got = lambda df: {(r.src, r.dst): (r["rank"], round(r.score, 9)) for r in df.collect()}
    assert got(knn.knn(p, 5)) == plain_knn(vectors, 5)
    assert got(knn.knn(p, 3, F.col("cluster_id"))) == plain_knn(vectors, 3, True)


def test_scores_held_at_once_do_not_grow_with_the_vectors(monkeypatch):
    import tracemalloc

    rng, peaks = np.random.default_rng(1), []
    q = rng.normal(size=(512, 16))
    for n in (8_192, 65_536):
        x = rng.normal(size=(n, 16)).astype(np.float32)
        best, near = np.full((512, 8), -np.inf), np.full((512, 8), 1 << 40)
        tracemalloc.start()
        knn._improve(best, near, q, np.arange(512) + (1 << 30), x, np.arange(n))
        peaks.append(tracemalloc.get_traced_memory()[1] - 3 * x.nbytes)
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (4 << 20)


def test_neighbours_need_no_shuffle_after_they_are_found(spark):
    for name in ("structural_holes", "local_clustering", "reachable_papers", "connected_components"):
        assert plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1, name


def test_saturation_meets_no_pairs_in_a_join(spark, vectors, tmp_path):
    rows = [(i, None if i == 7 else c, x[:3] if i % 13 == 0 else x) for i, c, x in vectors]
    spark.createDataFrame([(i, c, x) for i, c, x in rows if i % 13], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = plans.queries()["novelty_saturation"](spark, str(tmp_path))
    assert "NOT (paper_id" not in df._jdf.queryExecution().optimizedPlan().toString()
    sums = {}
    for (i, _), (_, s) in plain_knn([r for r in rows if r[0] % 13 and r[1] is not None], 3, True).items():
        sums.setdefault(i, []).append((s + 1) / 2)
    assert {r.paper_id: r.saturation for r in df.collect()} == {i: round(sum(s) / len(s), 6) for i, s in sums.items()}
    mixed = spark.createDataFrame(rows, "paper_id long, cluster_id int, embedding array<float>")
    got = knn.knn(mixed, 3, F.size("embedding")).collect()
    assert {(r.src % 13 == 0) for r in got} == {True, False} and all((r.src % 13 == 0) == (r.dst % 13 == 0) for r in got)
    with pytest.raises(ValueError):
        knn.knn(mixed, 3)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Vectors of which many are near copies of each other, some 100,000 apart in their numbers, in several files."""
    rng, folder = np.random.default_rng(2), str(tmp_path_factory.mktemp("crowded"))
    base = rng.normal(size=(40, 8)) * 0.4
    rows = [(i + 98_000 * (i >= 300), int(i) % 3, (base[i % 40] + 0.001 * rng.normal(size=8)).astype(np.float32).astype(float).tolist()) for i in range(3_000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(12, "vec_id").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["duplicate_papers", "duplicate_paper_groups", "papers_from_json"])
def test_equals_sql_on_crowded_vectors(spark, crowded, name):
    import duckdb

    from tests.test_oracles import rows

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{crowded}/embeddings.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plans.queries()[name](spark, crowded).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(got) == rows(db.execute(plans.oracle_sql()[name]).df())


def test_papers_are_carried_along_with_their_claims(spark, typed):
    got = claims.related_papers(typed)
    names = ["src_paper", "dst_paper", "kind", "n"]
    assert bag(got.select(*names)) == bag(claims.paper_edges(claims.relations(typed), typed).select(*names))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert plans.queries()["paper_relations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_betweenness_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    line = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    got = {r.node: r.betweenness for r in graph.betweenness(line.mapInPandas(count, line.schema), weighted=True).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 0.0} and seen.value == 2
