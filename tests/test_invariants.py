"""Queries that SQL can't express: plain recomputations, and what must hold whatever the seed."""
import difflib
import json
import os
import re

import numpy as np
import pytest

from skein import plans
from skein.operators import cluster, knn
from skein.sources.adapters import papers, texts

SF = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def run(spark, name):
    return plans.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def table(spark):
    rows = papers(spark, SF).orderBy("paper_id").collect()
    ids = np.array([r["paper_id"] for r in rows])
    return ids, np.array([r["embedding"] for r in rows], float), np.array([r["cluster_id"] for r in rows])


def test_whitened(spark, table):
    ids, x, _ = table
    got = {r["paper_id"]: r["embedding"] for r in run(spark, "whitened")}
    z = np.array([got[i] for i in ids])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.T @ z / len(z), np.eye(z.shape[1]), atol=1e-8)
    centred = x - x.mean(0)
    assert np.allclose(z @ np.linalg.lstsq(z, centred, rcond=None)[0], centred, atol=1e-8)  # nothing is lost


def test_factor_loadings(spark, table):
    ids, x, _ = table
    got = {r["paper_id"]: r["loadings"] for r in run(spark, "factor_loadings")}
    z = np.array([got[i] for i in ids])
    centred = x - x.mean(0)
    values = np.linalg.svd(centred, compute_uv=False)[: z.shape[1]]
    assert np.allclose(np.linalg.norm(z, axis=0), values, atol=1e-8)
    assert np.allclose(z.T @ z, np.diag(values**2), atol=1e-6)


def test_kmeans_clusters(spark, table):
    ids, x, _ = table
    got = {r["paper_id"]: r["cluster_id"] for r in run(spark, "kmeans_clusters")}
    label = np.array([got[i] for i in ids])
    assert len(got) == len(ids) and set(label) <= set(range(10)) and len(set(label)) > 1
    centre = np.array([x[label == k].mean(0) for k in sorted(set(label))])
    near = ((x[:, None] - centre[None]) ** 2).sum(2)
    spread = ((x - x.mean(0)) ** 2).sum()
    assert near.min(1).sum() < spread and (np.array(sorted(set(label)))[near.argmin(1)] == label).mean() > 0.95


def test_two_level_galaxy(spark, table):
    ids, x, _ = table
    rows = run(spark, "two_level_galaxy")
    assert sorted(r["paper_id"] for r in rows) == ids.tolist()
    inside = {}
    for r in rows:
        inside.setdefault(r["mega_id"], []).append((r["sub_id"], x[np.searchsorted(ids, r["paper_id"])]))
    assert 5 <= len(inside) <= 8
    for members in inside.values():
        v, s = np.array([m[1] for m in members]), np.array([m[0] for m in members])
        assert len(set(s)) <= 20
        assert sum(((v[s == k] - v[s == k].mean(0)) ** 2).sum() for k in set(s)) <= ((v - v.mean(0)) ** 2).sum() + 1e-12


def test_cluster_stability(spark, table):
    ids, x, label = table
    names = sorted(set(label))
    centre = np.array([x[label == k].mean(0) for k in names])
    d = np.sqrt(((x[:, None] - centre[None]) ** 2).sum(2))
    for r in run(spark, "cluster_stability"):
        i = np.searchsorted(ids, r["paper_id"])
        order = np.sort(d[i])
        assert r["cluster_id"] == label[i] and abs(r["distance_margin"] - (order[1] - order[0])) < 1e-9
        votes = {}
        for v in [label[i]] + [names[np.sqrt(((x[i] + 0.01 * np.random.default_rng([5, t, int(ids[i])]).normal(size=x.shape[1]) - centre) ** 2).sum(1)).argmin()] for t in (1, 2, 3)]:
            votes[v] = votes.get(v, 0) + 1
        p = np.array(sorted(votes.values(), reverse=True)) / 4
        assert abs(r["confidence"] - p[0]) < 1e-12 and abs(r["ambiguity"] + (p * np.log(p)).sum() / np.log(len(names))) < 1e-9
        assert abs(r["margin"] - (p[0] - (p[1] if len(p) > 1 else 0))) < 1e-12


def test_cluster_seed_stability(spark, table):
    rows = run(spark, "cluster_seed_stability")
    assert sorted(r["paper_id"] for r in rows) == table[0].tolist()
    assert all(min(abs(r["confidence"] - k / 3) for k in range(4)) < 1e-9 for r in rows)


def test_novelty_uncertainty(spark, table):
    ids, x, label = table
    centre = {k: x[label == k].mean(0) for k in set(label)}
    centre = {k: v / np.linalg.norm(v) for k, v in centre.items()}
    rows = run(spark, "novelty_uncertainty")
    assert len(rows) == len(ids)
    for r in rows:
        i = np.searchsorted(ids, r["paper_id"])
        all_of = [x[i]] + [x[i] + 0.01 * np.random.default_rng([9, t, int(ids[i])]).normal(size=x.shape[1]) for t in range(1, 6)]
        assert abs(r["uncertainty"] - np.std([np.linalg.norm(v - centre[label[i]]) for v in all_of])) < 1e-9


def test_layout_quality(spark, table):
    (r,) = run(spark, "layout_quality")
    z = np.array([v["embedding"] for v in knn.whiten(papers(spark, SF)).collect()])
    y = z[:, :2]
    y = (y - y.min(0)) / np.ptp(y, axis=0)
    n, k = len(z), r["k"]

    def places(v):
        out = np.zeros((n, n), int)
        for i in range(n):
            d = np.sqrt(((v - v[i]) ** 2).sum(1))
            out[i, sorted((j for j in range(n) if j != i), key=lambda j: (d[j], j))] = range(1, n)
        return out

    high, low = places(z), places(y)
    lost = sum(low[i, j] - k for i in range(n) for j in np.flatnonzero((high[i] <= k) & (high[i] > 0) & (low[i] > k)))
    false = sum(high[i, j] - k for i in range(n) for j in np.flatnonzero((low[i] <= k) & (low[i] > 0) & (high[i] > k)))
    scale = 2 / (n * k * (2 * n - 3 * k - 1))
    assert abs(r["continuity"] - (1 - scale * lost)) < 1e-3 and abs(r["trustworthiness"] - (1 - scale * false)) < 1e-3


def test_force_layout(spark):
    rows = run(spark, "force_layout")
    xy = np.array([(r["x"], r["y"]) for r in rows])
    assert xy.min() >= 0 and xy.max() <= 1 and np.allclose(np.ptp(xy, axis=0), 1)
    assert len({tuple(v) for v in xy.round(6)}) == len(rows) == len({r["cluster_id"] for r in rows})


def test_method_lens(spark):
    rows, again = run(spark, "method_lens"), run(spark, "method_lens")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in rows) and len(rows) == len({r["cluster_id"] for r in rows}) > 1


def test_factor_labels(spark):
    rows = run(spark, "factor_labels")
    by = {}
    for r in rows:
        by.setdefault(r["factor"], []).append((r["rank"], r["term"]))
    text = " ".join(" ".join(re.findall(r"\w\w+", r["text"].lower())) for r in plans.text._bench(spark, SF).collect())
    assert len(by) == 8
    for terms in by.values():
        assert [k for k, _ in sorted(terms)] == [1, 2, 3, 4] and len({t for _, t in terms}) == 4
        assert all(t in text for _, t in terms)


def test_summary_document(spark):
    (r,) = run(spark, "summary_document")
    doc = json.loads(r["document"])
    trends = sorted(map(tuple, run(spark, "topic_trends")))
    names = plans.queries()["topic_trends"](spark, SF).columns
    assert sorted(tuple(x[n] for n in names) for x in doc["topic_trends"]) == trends
    assert len(doc["coverage"]) == len(run(spark, "mean_year"))


def test_title_similarity(spark):
    titles = {r["paper_id"]: r["title"] for r in texts(spark, SF).collect()}
    from skein.functions.text import STOPWORDS

    words = lambda t: {w for w in re.findall(r"[a-z0-9]{3,}", t.lower()) if w not in STOPWORDS}
    rows = run(spark, "title_similarity")
    assert len(rows) == sum(i + 1 in titles for i in titles)
    for r in rows:
        a, b = titles[r["a"]], titles[r["b"]]
        x, y = words(a), words(b)
        share = len(x & y) / len(x | y) if x and y else 0.0
        flat = lambda t: re.sub(r"[ \t\n\r\f\v]+", " ", t).strip().lower()
        assert abs(r["similarity"] - (0.65 * share + 0.35 * difflib.SequenceMatcher(None, flat(a), flat(b)).ratio())) < 1e-9


def test_neighbours_are_found_once_in_a_plan(spark):
    for name in ("structural_holes", "local_clustering", "reachable_papers", "connected_components"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") <= 1, name


def test_ranks_in_blocks_equal_plain_ones():
    x = np.random.default_rng(3).normal(size=(70, 5))
    plain = np.argsort(np.argsort(np.where(np.eye(70) > 0, np.inf, ((x[:, None] - x[None]) ** 2).sum(2)), axis=1), axis=1) + 1
    assert (cluster.ranks(x, block=16) == plain).all() and (cluster.ranks(x) == plain).all()


def test_many_centroids_are_met_in_blocks(spark, table, monkeypatch):
    from skein.operators import novelty

    p = papers(spark, SF)
    centroids = novelty.centroid_mean(p).orderBy("cluster_id")
    few = {r["paper_id"]: (r["home"], r["d1"], r["d2"]) for r in cluster.nearest_centroids(p, centroids).collect()}
    monkeypatch.setattr(cluster, "FEW_CENTROIDS", 3)
    assert {r["paper_id"]: (r["home"], r["d1"], r["d2"]) for r in cluster.nearest_centroids(p, centroids).collect()} == few
