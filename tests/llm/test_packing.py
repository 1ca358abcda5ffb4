from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing
from tests.llm.util import awkward, clashing, empty, table


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(hist, k):
    lengths = sorted(hist)
    counts = [hist[x] for x in lengths]
    got = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
    m = min(k, len(lengths))
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], m - 1))
    assert len(got) == m and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_batches_keep_the_budget_and_lose_nothing(spark):
    texts = ["w " * (1 + i % 37) for i in range(300)]
    rows = packing.pack(table(spark, texts), buckets=4, budget=64).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    groups = {}
    for r in rows:
        assert r["n_tokens"] == 1 + r["doc_id"] % 37 <= r["bucket"]
        groups.setdefault((r["bucket"], r["batch"]), []).append(r["doc_id"])
    for (bucket, _), ids in groups.items():
        assert len(ids) == 1 or len(ids) * bucket <= 64
    for bucket in {b for b, _ in groups}:
        order = [i for b, k in sorted(x for x in groups if x[0] == bucket) for i in sorted(groups[b, k])]
        assert order == sorted(order)


def test_awkward_and_empty_tables(spark):
    rows = packing.pack(awkward(spark)).collect()
    assert len(rows) == 12
    assert all(r["bucket"] is None and r["batch"] is None for r in rows if not r["n_tokens"])
    assert sum(not r["n_tokens"] for r in rows) == 4
    assert packing.pack(empty(spark)).count() == 0


def test_any_ids_are_ranked_in_many_ranges(spark):
    ids = [(i * 0x9E3779B97F4A7C15 + 12345) % 2**63 for i in range(500)] + [None] * 3 + [7] * 4
    docs = spark.createDataFrame([(x, "w " * (1 + i % 23)) for i, x in enumerate(ids)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=3, budget=60).collect()
    bounds = sorted({r["bucket"] for r in rows})
    expected = []
    for b in bounds:
        mine = sorted(((-1 if x is None else x, 1 + i % 23) for i, x in enumerate(ids) if next(c for c in bounds if c >= 1 + i % 23) == b))
        expected += [(x, n, b, k // max(1, 60 // b)) for k, (x, n) in enumerate(mine)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["bucket"], r["batch"]) for r in rows) == sorted(expected)


def test_names_of_other_columns_are_ignored(spark):
    assert sorted(r["doc_id"] for r in packing.pack(clashing(spark)).collect()) == [0, 1, 2, 3]
