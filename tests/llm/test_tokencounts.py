import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.llm import tokencounts
from tests.llm.util import awkward, empty


def plain(ids, eod):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == eod:
            out.append((start, i - start))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=3), st.sampled_from([1, 4, 7, 1000]))
def test_counts_equal_a_plain_scan(spark, tmp_path_factory, files, block):
    folder = tmp_path_factory.mktemp("flat")
    data = []
    for k, ids in enumerate(files):
        np.array(ids, "<u2").tofile(folder / f"{k}.bin")
        data.append((f"file://{folder}/{k}.bin", 2 * len(ids)))
    got = tokencounts.token_counts(spark.createDataFrame(data, "path string, n_bytes long"), eod=3, block=block).collect()
    for k, ids in enumerate(files):
        mine = sorted((r["ord"], r["start"], r["n_tokens"]) for r in got if r["path"].endswith(f"/{k}.bin"))
        assert mine == [(i, *x) for i, x in enumerate(plain(ids, 3))]


def test_wrong_size_raises(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        tokencounts.token_counts(spark.createDataFrame([(f"file://{tmp_path}/x.bin", 3)], "path string, n_bytes long")).collect()


@pytest.mark.skipif(not os.path.exists(tokencounts.TOKENIZERS), reason="no vocabulary files")
def test_documents(spark):
    e = tokencounts._encoding(f"{tokencounts.TOKENIZERS}/{tokencounts.VOCABULARY}")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in tokencounts.document_token_counts(awkward(spark)).where("doc_id IS NOT NULL").collect())
    assert got == sorted((r["doc_id"], len(e.encode_ordinary(r["text"] or ""))) for r in awkward(spark).collect() if r["doc_id"] is not None)
    assert tokencounts.document_token_counts(awkward(spark)).count() == 12
    assert tokencounts.document_token_counts(empty(spark)).count() == 0
