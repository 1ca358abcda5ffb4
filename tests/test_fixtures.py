"""Small inputs with results derived by hand."""
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import python as P
from skein.functions import text as T
from skein.functions import vector as V
from skein.operators import claims, cluster, graph, hygiene, knn, novelty, recommend, topics
from skein.sources import readers, sinks


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


def papers(spark, data):
    return spark.createDataFrame(data, "paper_id long, cluster_id int, year int, embedding array<double>")


def test_topic_evolution(spark):
    p = papers(spark, [(i, 1, y, [0.0]) for i, y in enumerate([2018, 2019, 2019, 2021])])
    got = {r["year"]: r for r in topics.topic_evolution(p).collect()}
    assert (got[2018]["n"], got[2019]["n"], got[2019]["burst"], got[2020]["decay"]) == (1, 2, True, True)


def test_method_takeover(spark):
    t = spark.createDataFrame([(2018, "Q-learning baseline"), (2019, "Uses PPO policy gradient"), (2020, "Improved PPO with entropy bonus"), (2021, "Q-learning variant")], "year int, s string")
    (r,) = topics.method_takeovers(topics.method_mentions(t, ["q-learning", "ppo"], ["s"])).collect()
    assert (r["crossing_year"], r["leader"]) == (2020, "ppo")


def test_reading_lag(spark):
    d = spark.createDataFrame([(0, 2021, 2021), (1, 2018, 2022), (1, 2019, 2021)], "cluster_id int, pub_year int, read_year int")
    got = {r["cluster_id"]: r for r in topics.reading_lag(d).collect()}
    assert got[0]["kind"] == "real-time" and got[1]["kind"] == "late" and got[1]["mean_lag"] == 3.0


def test_claims_of_a_summary(spark):
    text = "We show that the market maker with Poisson arrivals and risk-neutral agents improves PnL. Tests on LOBSTER (2019-2020) reach a higher Sharpe."
    assert len(one(spark, T.claims_of, t=text)) == 1
    assert {"poisson arrivals", "risk-neutral"} <= set(one(spark, lambda t: T.lexicon_hits(t, T.ASSUMPTIONS), t=text))
    e = one(spark, T.evaluation, t=text)
    assert e["dataset"] == "LOBSTER" and e["period"] == "2019-2020" and {"Sharpe ratio", "PnL"} <= set(e["metrics"])


def test_claim_relations(spark):
    c = spark.createDataFrame([("a", "Our model improves accuracy", "CIFAR-10", ["accuracy"]), ("b", "It does not improve accuracy", "CIFAR-10", ["accuracy"]), ("c", "This extends a and can further improve it", "CIFAR-10", ["accuracy"])], "claim_id string, statement string, dataset string, metrics array<string>")
    got = {(r["src"], r["dst"]): r["kind"] for r in claims.relations(c).collect()}
    assert got["a", "b"] == "contradicts" and got["a", "c"] == "extends"


def test_stress_test(spark):
    c = spark.createDataFrame([(1, "A", "x", 0.6, ["infinite liquidity"]), (2, "B", "infinite liquidity is bad", 0.6, ["bounded inventory"])], "paper_id int, claim_id string, statement string, strength double, assumptions array<string>")
    p = spark.createDataFrame([(3, "t", ["Infinite Liquidity"]), (4, "u", None)], "paper_id int, title string, assumptions array<string>")
    got = {r["claim_id"]: r["strength"] for r in claims.stress_test(c, p, "infinite liquidity").collect()}
    assert got == {"A": 0.6, "proxy#3": 0.3}


def test_method_pipeline(spark):
    got = one(spark, T.method_pipeline, t="Order book data, a DQN agent, Sharpe as a measure")
    assert [s["stage"] for s in got] == ["data", "preprocessing", "model", "objective", "evaluation"]
    assert got[2]["label"] == "DQN" and got[4]["label"] == "Sharpe ratio"


def test_nearest_to(spark):
    p = papers(spark, [(0, 0, 1, [1.0, 0.0, 0.0]), (1, 0, 1, [0.0, 1.0, 0.0]), (2, 0, 1, [0.0, 0.0, 1.0])])
    got = knn.nearest_to(p, [1.0, 0.1, 0.0], 2).collect()
    assert [r["paper_id"] for r in got] == [0, 1] and got[0]["score"] > got[1]["score"]
    assert knn.nearest_to(p, [1.0, 0.0], 2).count() == 0 and knn.nearest_to(p, [1.0, 0.0, 0.0], 0).count() == 0


def test_chunks():
    c = P.chunk_text("abcd " * 800, 500, 50, 10)
    assert all(len(x) <= 500 for x in c) and c[0][-50:] == c[1][:50]
    assert P.chunk_text("short text") == ["short text"] and P.chunk_text("") == []
    assert len(P.chunk_text("x" * 10_000, 400, 0, 3)) == 3


def test_galaxy_assigns_every_paper(spark):
    p = papers(spark, [(i, 0, 2020 + i % 4, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(12)])
    got = cluster.galaxy(p, 2, 2).collect()
    assert sorted(r["paper_id"] for r in got) == list(range(12)) and len({r["mega_id"] for r in got}) == 2


def test_blind_spot_curriculum(spark):
    p = papers(spark, [(1, 0, 1, [1.0, 0.0]), (2, 0, 1, [0.0, 1.0]), (3, 0, 1, [0.7, 0.3])])
    read = p.where("paper_id = 1").select("paper_id")
    assert recommend.profile_blind_spots(p, read, 1).first()["paper_id"] == 2
    many = papers(spark, [(i, 0, 1, [math.cos(i / 6), math.sin(i / 6)]) for i in range(12)])
    stages = {r["stage"]: r for r in recommend.curriculum(many, many.where("paper_id = 0").select("paper_id"), [0.0, 1.0]).collect()}
    assert set(stages) == {"foundation", "bridge", "advanced"}


def test_upsert(spark):
    a = spark.createDataFrame([("f", "Title", "one", 1)], "file_path string, title string, summary string, at int")
    b = spark.createDataFrame([("f", "Title 2", "Summary two", 2)], "file_path string, title string, summary string, at int")
    (r,) = hygiene.upsert(a, b, "file_path", "at").collect()
    assert (r["title"], r["summary"]) == ("Title 2", "Summary two")


def test_json_repair(spark):
    assert json.loads(P.repair('Sure: {"a": 1, "b": [2, 3]} ok')) == {"a": 1, "b": [2, 3]}
    assert json.loads(P.repair("```json\n{“scores”: {“x”: 7,}, }\n```")) == {"scores": {"x": 7}}
    assert P.repair("none here") is None and P.repair(None) is None
    assert one(spark, T.lossy_number, t="8/10") == 8.0
    assert one(spark, T.string_list, t="PURE_ALPHA, MODELING") == ["PURE_ALPHA", "MODELING"]
    assert json.loads(one(spark, P.repair_json, t='x {"a": [1,]}')) == {"a": [1]}


def test_years_and_titles(spark):
    year = lambda t, f: T.infer_year(t, f, 2030)
    assert one(spark, year, t="This study (2017) shows", f="a.pdf") == 2017
    assert one(spark, year, t="no year 12345", f="2512.12039v1_x.pdf") == 2025
    assert one(spark, year, t="none", f="2513.12039.pdf") is None
    assert one(spark, T.infer_title, m=" ", t="First line\nrest", f="a.pdf") == "First line"


def test_components_and_betweenness(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src int, dst int, weight double")
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    line = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src int, dst int, weight double")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(line, weighted=True).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0}
    tri = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)], "src int, dst int, weight double")
    assert all(r["betweenness"] == 0 for r in graph.betweenness(tri, weighted=True).collect())
    star = spark.createDataFrame([(0, i, 1.0) for i in (1, 2, 3)], "src int, dst int, weight double")
    mode = lambda m: {r["node"]: r["betweenness"] for r in graph.betweenness(star, normalization=m).collect()}[0]
    assert mode("reference") == pytest.approx(2.0) and mode("standard") == pytest.approx(1.0)


@pytest.mark.parametrize("local", [True, False])
def test_pagerank_loses_dangling_mass(spark, monkeypatch, local):
    if not local:
        monkeypatch.setattr(graph, "LOCAL_EDGES", -1)
    e = spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, weight double")
    n = spark.createDataFrame([(0,), (1,)], "node int")
    got = {r["node"]: r["rank"] for r in graph.pagerank(e, n, rounds=12).collect()}
    assert got[0] == pytest.approx(0.075) and got[1] == pytest.approx(0.13875)


def test_eigenvector_agrees_both_ways(spark, monkeypatch):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (2, 0, 0.8), (0, 2, 0.3), (3, 0, 1.0)], "src int, dst int, weight double")
    n = spark.createDataFrame([(i,) for i in range(4)], "node int")
    a = {r["node"]: r["centrality"] for r in graph.eigenvector(e, n).collect()}
    monkeypatch.setattr(graph, "LOCAL_EDGES", -1)
    b = {r["node"]: r["centrality"] for r in graph.eigenvector(e, n, rounds=60, written=10).collect()}
    assert all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_layout_quality_of_few_papers(spark):
    x = np.random.default_rng(1).normal(size=(9, 8))
    r = cluster.layout_quality(papers(spark, [(i, 0, 1, v.tolist()) for i, v in enumerate(x)])).first()
    assert r["n"] == 9 and r["k"] <= 7 and 0 <= r["p95"] <= 1


def test_seed_stability_of_clear_clusters(spark):
    p = papers(spark, [(0, 0, 1, [0.0, 0.0, 0.0]), (1, 0, 1, [0.1, 0.0, 0.0]), (2, 1, 1, [10.0, 0.0, 0.0]), (3, 1, 1, [10.1, 0.0, 0.0])])
    got = cluster.seed_stability(p, 5).collect()
    assert len(got) == 4 and all(r["confidence"] >= 0.6 for r in got)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5):
        c = rng.random((n, n))
        got = cluster.assign_clusters(c)
        assert sorted(got) == list(range(n))
        assert c[np.arange(n), got].sum() == pytest.approx(min(c[np.arange(n), list(p)].sum() for p in permutations(range(n))))


def test_burst_maximum_and_changepoints(spark):
    s = spark.createDataFrame([("c", 2000 + i, n) for i, n in enumerate([0, 0, 0, 1])], "cluster_id string, year int, n int")
    assert topics.burst_scores(s).orderBy("year").collect()[-1]["z"] == pytest.approx(1.5)
    s = spark.createDataFrame([("c", 2000 + i, n) for i, n in enumerate([1, 3, 1, 4, 1, 5])], "cluster_id string, year int, n int")
    assert [r["year"] for r in topics.changepoints(s, min_gap=2).orderBy("year").collect()] == [2002, 2004]


def test_scores_by_hand(spark):
    log = spark.createDataFrame([(1, "opened", 1), (2, "opened", 1), (2, "opened", 2), (2, "note_saved", 3)], "paper_id long, event_type string, ts int")
    got = {r["paper_id"]: r["read_score"] for r in recommend.read_scores(log).collect()}
    assert got[1] == pytest.approx(0.423050, abs=1e-6) and got[2] == pytest.approx(0.864665, abs=1e-6)
    z = novelty.z_scores(spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0)], "year int, v double"), "v", "year")
    assert all(r["z"] == 0 for r in z.collect())
    j = one(spark, lambda a, b: T.jaccard(a, b), a=["a1b", "cat", "dog"], b=["cat", "dog", "owl"])
    assert j == 0.5 and one(spark, lambda a, b: T.jaccard(a, b), a=["x"], b=[]) == 0.0


def test_pareto(spark):
    p = spark.createDataFrame([(1, 3.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 0.0)], "paper_id long, novelty double, consensus double")
    assert {r["paper_id"] for r in recommend.pareto(p).collect()} == {1, 2}
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((500, 2)))]
    got = {r["paper_id"] for r in recommend.pareto(spark.createDataFrame(pts, p.schema)).collect()}
    assert got == {i for i, a, b in pts if not any(x >= a and y >= b and (x, y) != (a, b) for _, x, y in pts)}


def test_drift_by_hand(spark):
    got = {r["year"]: r for r in topics.drift(papers(spark, [(0, 0, 2020, [0.0, 0.0]), (1, 0, 2021, [3.0, 4.0])])).collect()}
    assert got[2020]["drift"] == 0 and (got[2021]["drift"], got[2021]["dx"], got[2021]["dy"], got[2021]["from_year"]) == (5.0, 0.6, 0.8, 2020)


def test_recombination_entropy(spark):
    p = papers(spark, [(i, i % 2, 1, [1.0]) for i in range(9)])
    n = spark.createDataFrame([(8, i) for i in range(8)], "src long, dst long")
    assert graph.recombination(n, p).first()["recombination"] == pytest.approx(1.0)


def test_vectors_of_zero_and_other_dimension(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("z")).alias("zero"), V.cosine(F.col("a"), F.col("s")).alias("other"), V.squared_distance(F.col("a"), F.col("s")).alias("far"), V.unit(F.col("z")).alias("u"), V.fit_dimension(F.col("s"), 3).alias("p")).first()
    assert (r["zero"], r["other"], r["far"], r["u"], r["p"]) == (0.0, None, math.inf, [0.0, 0.0], [1.0, 0.0, 0.0])


def test_knn_blocks_equal_the_broadcast_form(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = papers(spark, [(i, 0, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))])
    key = lambda d: sorted((r["src"], r["dst"], r["rank"], round(r["score"], 9)) for r in d.collect())
    a = key(knn.knn(p, 4))
    monkeypatch.setattr(knn, "MATRIX_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    assert key(knn.knn(p, 4)) == a and len(a) == 240


def test_whitening_gives_unit_variance(spark):
    x = np.random.default_rng(5).normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0])
    z = np.array([r["embedding"] for r in knn.whiten(papers(spark, [(i, 0, 1, v.tolist()) for i, v in enumerate(x)])).collect()])
    assert z.shape == (200, 5) and np.allclose(z.var(axis=0), 1) and np.allclose(z.mean(axis=0), 0)


def test_marginal_gain_is_greedy(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, centroid array<double>")
    cov = spark.createDataFrame([(0, 0.9), (1, 0.0)], "cluster_id int, coverage double")
    p = papers(spark, [(1, 0, 1, [1.0, 0.0]), (2, 1, 1, [0.0, 1.0]), (3, 0, 1, [0.7, 0.7])])
    s = spark.createDataFrame([], "paper_id long, read_score double")
    got = [r["paper_id"] for r in recommend.marginal_gain(c, cov, p, s).orderBy("pick").collect()]
    assert got[0] == 2 and got[1] == 1


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    paper = {"id": "p1", "title": "T", "filePath": "/a.pdf", "embedding": [0.1, 0.2], "keywords": ["k"], "ingestedAt": "2024-01-02T03:04:05Z", "firstReadAt": 0, "tradingScores": {"usability": 2.0, "strategyImpact": 3.0, "confidence": 0.5}, "claims": [{"id": "c", "statement": "s"}]}
    (tmp_path / "papers/a.json").write_text(json.dumps(paper, indent=1))
    (tmp_path / "papers/b.json").write_text(json.dumps({"id": "p2", "title": "no vector"}))
    (r,) = readers.read_papers(spark, f"{tmp_path}/papers/*.json").collect()
    assert r["tags"] == ["k"] and r["priority"] == 3.0 and r["ingested_at"].year == 2024 and r["first_read_at"].year == 2001
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/e.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","event_type":"opened","paper_id":"p1","x":"y"}\n\nbroken {\n{"no": 1}\n')
    (e,) = readers.read_events(spark, f"{tmp_path}/ev").collect()
    assert e["event_type"] == "opened" and e["extras"] == {"x": "y"}
    sinks.append_events(readers.read_events(spark, f"{tmp_path}/ev"), f"{tmp_path}/out")
    back = readers.read_events(spark, f"{tmp_path}/out").first()
    assert back["extras"] == {"x": "y"} and back["ts"] == e["ts"]
    (tmp_path / "edges.json").write_text(json.dumps({"edges": [{"sourceClaimID": "a", "targetClaimID": "b", "kind": "supports"}, {"source_claim_id": "b", "target_claim_id": "c", "kind": "extends"}]}))
    assert {(x["src"], x["dst"]) for x in readers.read_claim_edges(spark, f"{tmp_path}/edges.json").collect()} == {("a", "b"), ("b", "c")}
    p = readers.read_papers(spark, f"{tmp_path}/papers/*.json")
    chunks = spark.createDataFrame([("c1", "p1", "t")], "chunk_id string, paper_id string, text string")
    assert set(sinks.export(sinks.export_tables(p, chunks), f"{tmp_path}/db")) == {"papers", "paper_embeddings", "paper_chunks", "claims", "methods"}
    assert spark.read.parquet(f"{tmp_path}/db/claims.parquet").first()["statement"] == "s"
    doc = json.loads(sinks.summary({"novelty": (spark.range(60), [F.desc("id")])}).first()["document"])
    assert len(doc["novelty"]) == 50


def test_streaming_agrees_with_batch(spark, tmp_path):
    from skein.streaming import events as S

    data = [(i, f"2024-01-{1 + i % 3:02d} {i % 24:02d}:00:00", ["opened", "note_saved"][i % 2], i % 5) for i in range(60)]
    batch = spark.createDataFrame(data, "event_id long, t string, event_type string, paper_id long").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "paper_id")
    batch.write.parquet(f"{tmp_path}/e")
    live = lambda: spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/e")
    got = {r["paper_id"]: round(r["read_score"], 9) for r in S.run_to_end(S.read_scores(live()), "scores").collect()}
    assert got == {r["paper_id"]: round(r["read_score"], 9) for r in recommend.read_scores(batch).collect()}
    per_day = {(r["start"].day, r["event_type"]): r["n"] for r in S.run_to_end(S.counts(live(), late="3 days"), "counts", "update").collect()}
    assert per_day == {(r["d"], r["event_type"]): r["count"] for r in batch.groupBy(F.dayofmonth("ts").alias("d"), "event_type").count().collect()}
