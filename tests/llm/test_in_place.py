"""The search without a shuffle against that with one."""
import numpy as np

from skein.llm import ann


def test_both_ways_of_searching_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:140] = x[5]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(700), x)], "vec_id long, embedding array<float>")
    got = lambda: sorted(map(tuple, ann.nearest(df, 5, rows_per_partition=60).collect()))
    called = []
    monkeypatch.setattr(ann, "in_place", lambda *a, f=ann.in_place: called.append(1) or f(*a))
    one = got()
    monkeypatch.setattr(ann, "PART_BYTES", 4_000)
    monkeypatch.setattr(ann, "TASK_ROWS", 50)
    assert got() == one and len(one) == 3_500 and len(called) == 2
    monkeypatch.setattr(ann, "DENSE", 2)
    assert got() == one and len(called) == 2
