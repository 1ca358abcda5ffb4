import random

import corpus_pipeline
from tests.llm.test_quality import texts as quality_texts
from tests.llm.util import SCHEMA, awkward, empty, rows


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def chain(spark, docs, sf_dir):
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir))
    return kept


def test_stages_take_effect(spark, tmp_path):
    n = 100
    texts = quality_texts(n, 1)
    copies = {1000 + i: texts[i] for i in range(10)}
    noise = {2000: "".join(random.Random(1).choice("qxzjkvwyp") for _ in range(500)), 2001: "", 2002: "### !!"}
    fresh = quality_texts(9, 7)[:9]
    secret = {3000: " ".join(fresh[:5]) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + " ".join(fresh[5:])}
    data = [(i, t, "la" if i < 2000 else None, *r[3:]) for i, t in {**dict(enumerate(texts)), **copies, **noise, **secret}.items() for r in rows([t])]
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")
    sf_dir = folder(spark, tmp_path, docs, labels)
    kept = chain(spark, docs, sf_dir)
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert not ids[1] & set(noise) and len(ids[1]) >= len(data) - 4 - n // 2
    assert len(ids[2] & set(range(n))) >= n - 2 and len(ids[2] & set(range(n, 2 * n))) <= n // 10
    assert not ids[3] & set(copies) and set(range(10)) & ids[2] <= ids[3]
    assert ids[4] == ids[3] == ids[5]
    assert "<secret:assigned_secret>" in kept[4].where("doc_id = 3000").first()["text"]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids[5]


def test_every_stage_bears_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((awkward(spark), empty(spark))):
        sf_dir = folder(spark, tmp_path / str(k), docs, labels)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= docs.count()
        corpus_pipeline.run(spark, sf_dir).collect()
