import random

import numpy as np
import pyarrow as pa

from skein.llm import simhash
from skein.llm.common import text_buffers
from skein.llm.components import components
from tests.llm.util import awkward, clashing, empty, same_rows, table


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    out = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            out.append(" ".join(w if r.random() > 0.03 else r.choice(vocabulary) for w in base))
    return out + out[:5] + ["same words here"] * 40


def brute(texts):
    off, raw = text_buffers(pa.array(texts))
    fp, known = simhash.fingerprints(off, raw)
    values, first = simhash.sketches(off, raw)
    sk = [set(values[a:b].tolist()) for a, b in zip(first, first[1:])]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if known[i] and known[j] and int(np.bitwise_count(np.uint64(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)))) <= simhash.TAU:
                union = sorted(sk[i] | sk[j])[: simhash.SKETCH]
                if len(set(union) & sk[i] & sk[j]) / max(1, len(union)) >= simhash.SIMILAR:
                    a, b = sorted((find(i), find(j)))
                    group[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_groups_equal_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == brute(texts)
    assert len(set(got.values())) < len(texts) - 60


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = set(base.tolist())
    for x in base.tolist():
        for flips in (1, 6, 10, 11, 14):
            for b in rng.choice(62, flips, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    got = {(r["p"], r["q"]) for r in simhash.candidate_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= simhash.TAU}
    assert got == expected and len(got) > 40


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    hists = {m: [rng.integers(0, 5, 1 << w) for w in simhash.widths_of(m)] for m in (4, 5)}
    widths, ts = simhash.choose_thresholds(hists, 1000)
    assert sum(widths) == 64 and sum(t + 1 for t in ts) >= simhash.TAU + 1


def test_one_document_of_each_group_stays(spark):
    texts = corpus()
    groups = brute(texts)
    docs = table(spark, texts)
    kept = simhash.deduplicate(docs.unionByName(docs.where("doc_id < 3")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_awkward_and_empty_tables(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[4]["group_id"] == 0 and by_id[4]["duplicate"]
    assert all(by_id[i]["group_id"] == i and not by_id[i]["duplicate"] for i in (1, 2, 5, 7))
    assert all(r["group_id"] is None and not r["duplicate"] for r in rows if r["doc_id"] is None)
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(awkward(spark)).collect()) == sorted(map(str, [0, 1, 2, 3, 5, 6, 7, None, None]))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_of_other_columns_are_kept(spark):
    docs = clashing(spark)
    same_rows(simhash.deduplicate(docs), docs, [0, 1])
    same_rows(simhash.deduplicate(docs.unionByName(docs)), docs, [0, 1])


def test_covers_hold_every_mask_once():
    for width, radius in ((16, 0), (16, 2), (13, 3), (8, 1)):
        for blocks in range(radius + 1, width + 1, 3):
            found = simhash.covers(width, radius, blocks)
            assert sorted(m for _, masks in found for m in masks) == sorted(simhash.ball(width, radius))
            assert all(not m & key for key, masks in found for m in masks)


def test_finer_buckets_find_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    fps = sorted({int(x) ^ (1 << int(b)) for x in rng.integers(-(2**62), 2**62, 12) for b in rng.integers(0, 62, 40)})
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= simhash.TAU}
    for most in (1, 60):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
        monkeypatch.setattr(simhash, "CANDIDATES", most)
        assert {(r["p"], r["q"]) for r in simhash.candidate_pairs(rows).collect()} == expected
