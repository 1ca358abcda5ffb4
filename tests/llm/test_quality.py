import math
import random
import re
from collections import Counter

import numpy as np

from skein.llm import quality
from tests.llm.util import awkward, clashing, empty, same_rows, table


def texts(n, seed):
    r = random.Random(seed)
    w = "lorem ipsum dolor sit amet vita brevis ars longa terra nova mare luna sol via porta".split()
    good = [" ".join(r.choice(w) for _ in range(r.randint(15, 80))) + "." for _ in range(n)]
    bad = [" ".join(r.choice(w) + r.choice(["%%%", "###", "$$$"]) for _ in range(r.randint(15, 80))) for _ in range(n // 2)]
    bad += [" ".join([r.choice(w)] * r.randint(20, 90)) for _ in range(n - n // 2)]
    return good + bad


def labels(spark, n):
    return spark.createDataFrame([(i, 1 if i < n else 0, 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_calibration(spark):
    model = quality.train(table(spark, texts(120, 1)), labels(spark, 120))
    got = {r["doc_id"]: r for r in quality.classify(table(spark, texts(60, 2)), model).collect()}
    right = [(got[i]["probability"] >= 0.5) == (i < 60) for i in range(120)]
    assert np.mean(right) >= 0.95
    assert model.network.temperature > 0
    assert sum(got[i]["keep"] for i in range(60)) >= 59


def test_word_table_equals_a_plain_count(spark):
    data = ["a b c a", "b, b", None, ""]
    got = quality.word_table(table(spark, data).repartition(2))
    where, sign = quality.index_vectors()
    from skein.llm.common import text_buffers
    import pyarrow as pa

    expected = np.zeros((quality.BUCKETS, quality.DIM + 1))
    for t in data:
        off, raw = text_buffers(pa.array([t]))
        ids = quality.token_buckets(off, raw)[0].tolist()
        for i, x in enumerate(ids):
            expected[x, quality.DIM] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    np.add.at(expected[x], where[ids[j]], sign[ids[j]])
    assert np.allclose(got, expected)


def test_awkward_and_empty_tables(spark):
    model = quality.train(table(spark, texts(40, 1)), labels(spark, 40))
    got = quality.classify(awkward(spark), model).collect()
    assert len(got) == 12
    assert sum(r["probability"] is None for r in got) == 4 and all(not r["keep"] for r in got if r["probability"] is None)
    assert quality.keep_good(awkward(spark), model).columns == awkward(spark).columns
    assert quality.classify(empty(spark), model).count() == 0
    none = quality.train(empty(spark), labels(spark, 0))
    assert none.network is None
    assert all(r["keep"] and r["probability"] is None for r in quality.classify(awkward(spark), none).collect())


def plain_features(texts):
    """Features of every text by loops over its tokens, with word vectors from all of them."""
    from skein.llm.common import text_buffers
    import pyarrow as pa

    def bucket(word):  # the hash of a token is that of a text of one token
        off, raw = text_buffers(pa.array([word]))
        return int(quality.token_buckets(off, raw)[0][0])

    tokens = [re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", t or "") for t in texts]
    number = {w: bucket(w) for w in {w for t in tokens for w in t}}
    where, sign = quality.index_vectors()
    context, count = {}, Counter()
    for t in tokens:
        ids = [number[w] for w in t]
        count.update(ids)
        for i, x in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    v = context.setdefault(x, [0.0] * quality.DIM)
                    for p, q in zip(where[ids[j]], sign[ids[j]]):
                        v[p] += q
    n = sum(count.values())
    unit = {b: np.array(context.get(b, [0.0] * quality.DIM)) for b in count}
    unit = {b: v / max(np.linalg.norm(v), 1e-9) for b, v in unit.items()}
    common = sum(count[b] / n * v for b, v in unit.items())
    weight = {b: quality.SIF / (quality.SIF + count[b] / n) for b in count}
    out = []
    for t in tokens:
        ids = [number[w] for w in t]
        total = sum(weight[b] for b in ids)
        mean = sum(weight[b] * (unit[b] - common) for b in ids) / max(total, 1e-9) if ids else np.zeros(quality.DIM)
        beside = sum(float((unit[a] - common) @ (unit[b] - common)) for a, b in zip(ids, ids[1:])) / max(len(ids) - 1, 1)
        out.append([*mean, np.linalg.norm(mean), beside, math.log1p(len(ids))])
    return np.array(out), np.array([len(t) for t in tokens])


def test_every_score_equals_a_plain_computation(spark):
    data = texts(60, 5) + ["", None, "solo", "#"]
    docs = table(spark, data)
    model = quality.train(docs, labels(spark, 60))
    got = {r["doc_id"]: (r["probability"], r["keep"]) for r in quality.classify(docs.repartition(3), model).collect()}
    x, n = plain_features(data)
    net = quality.fit(x[:120], np.array([1] * 60 + [0] * 60))
    for i in range(len(data)):
        if not n[i]:
            assert got[i] == (None, False)
            continue
        h = [math.tanh(sum((x[i][a] - net.mean[a]) / net.scale[a] * net.w1[a][k] for a in range(len(x[i]))) + net.b1[k]) for k in range(quality.HIDDEN)]
        z = [sum(h[k] * net.w2[k][c] for k in range(quality.HIDDEN)) + net.b2[c] for c in (0, 1)]
        p = 1 / (1 + math.exp((z[0] - z[1]) / net.temperature))
        assert abs(got[i][0] - p) < 0.02
        assert got[i][1] == (got[i][0] >= model.network.threshold)
    assert abs(model.network.threshold - net.threshold) < 0.02


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = table(spark, texts(40, 3))
    a, b = (quality.word_table(docs.repartition(k)) for k in (1, 7))
    assert (a == b).all()


def test_names_of_other_columns_are_kept(spark):
    docs = clashing(spark)
    labelled = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, quality.train(docs, labelled))
    assert kept.columns == docs.columns
    same_rows(kept, docs)
