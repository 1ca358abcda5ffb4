import base64
import os
import resource

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe, tokencounts
from tests.llm.util import awkward, empty, table

PATH = os.path.join(os.environ.get("SKEIN_TOKENIZERS", bpe.TOKENIZERS), bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("other", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return bpe.codec(PATH).encode(np.array([0, len(raw)]), raw)[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'ll", "'", "  ", "\n", " ", "the", "é", "日本", "12", "!?", "ing", "\U0001F600", "'D", "\t"]), max_size=25).map("".join) | st.text(max_size=40))
def test_equals_another_encoder(other, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert encode(text) == other.encode_ordinary(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["th", "e", "ing", "a", "on", "q", "er"]), min_size=200, max_size=900).map("".join), st.integers(1, 90))
def test_streaming_long_pieces(other, text, step):
    m = bpe.load_merges(PATH)
    e, out, early = bpe.Encoder(m), [], 0
    data = text.encode()
    for i in range(0, len(data), step):
        new = e.feed(data[i: i + step])
        early += len(new)
        out += new
    assert out + e.finish() == other.encode_ordinary(text)
    assert e.held <= m.lookahead() + 2 * m.longest
    assert early > 0 or len(data) <= e.held + step + 2 * m.longest


def test_long_repetition_is_stable(other):
    m = bpe.load_merges(PATH)
    e = bpe.Encoder(m)
    out = e.feed(b"a" * 20_000)
    assert len(e.tail) <= m.lookahead() + 2 * m.longest
    assert out + e.finish() == other.encode_ordinary("a" * 20_000)


def test_decoder_holds_back_unfinished_characters():
    m = bpe.load_merges(PATH)
    text = "häß 日本語 \U0001F600 ok"
    ids = [m.ranks[bytes([b])] for b in text.encode()]
    d = bpe.Decoder(m)
    parts = [d.feed([i]) for i in ids]
    assert "".join(parts) + d.finish() == text and "�" not in "".join(parts)
    broken = bpe.Decoder(m)
    assert broken.feed([m.ranks[b"\xe6"]]) == "" and broken.finish() == "�"
    with pytest.raises(IndexError):
        bpe.Decoder(m).feed([10**6])


def test_documents_round_trip(spark, other):
    rows = {r["doc_id"]: r for r in bpe.encode_documents(awkward(spark), PATH).where("doc_id IS NOT NULL").collect()}
    texts = {r["doc_id"]: r["text"] for r in awkward(spark).collect()}
    for i, r in rows.items():
        if texts[i] is None:
            assert r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["tokens"] == other.encode_ordinary(texts[i]) and r["n_tokens"] == len(r["tokens"]) and r["round_trip"]
    assert bpe.encode_documents(awkward(spark), PATH).count() == 12
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
    assert bpe.encode_documents(table(spark, ["x"]), PATH).first()["n_tokens"] == 1


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'ll", "'", "''", "  ", "\n", " ", "the", "é", "日本", "12", "!?", "ing", "\U0001F600", "'D", "\t", "a" * 30, "?" * 30, " " * 30]), max_size=25).map("".join), st.integers(1, 40), st.sampled_from([4, 9, 4096]))
def test_chunks_change_nothing(other, text, step, hold):
    data, before = text.encode(), bpe.HOLD
    bpe.HOLD = hold
    try:
        e = bpe.TextEncoder(bpe.codec(PATH))
        got = [x for i in range(0, len(data), step) for x in e.feed(data[i: i + step]).tolist()] + e.finish().tolist()
    finally:
        bpe.HOLD = before
    assert got == other.encode_ordinary(text)
    assert e.held <= step + hold + 2 * bpe.SETTLED


def test_a_text_of_64_megabytes_takes_constant_memory(other):
    part = ("The house by the water, 1984: it's là 日本. " * 24_000)[: 1 << 20].encode()[: 1 << 20].decode(errors="ignore").encode()
    e, d, n, ids = bpe.TextEncoder(bpe.codec(PATH)), bpe.Decoder(bpe.load_merges(PATH)), 64, []
    whole, count, waiting = part.decode(), 0, ""
    for k in range(n):
        new = e.feed(part)
        count += len(new)
        waiting += d.feed(new.tolist())
        assert waiting.startswith(whole[: len(waiting)]) and len(waiting) <= 2 * len(whole)
        waiting = waiting[len(whole):] if len(waiting) >= len(whole) else waiting
        if k == 3:
            used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    last = e.finish()
    waiting += d.feed(last.tolist()) + d.finish()
    assert waiting == "" or waiting == whole
    assert e.held <= bpe.CHUNK_BYTES + bpe.HOLD + 2 * bpe.SETTLED
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - used < 64 << 10  # kilobytes
    assert count + len(last) > n * len(other.encode_ordinary(whole)) - 2 * n


def test_one_piece_of_a_megabyte_is_streamed(other):
    c = bpe.codec(PATH)
    e, data = bpe.TextEncoder(c), b"x" + b"ab" * 150_000
    out = [x for i in range(0, len(data), 1 << 16) for x in e.feed(data[i: i + (1 << 16)]).tolist()]
    assert e.piece is not None and len(e.piece.tail) <= c.m.ahead + c.m.longest and len(out) > 1000
    out += e.finish().tolist()
    assert b"".join(c.m.tokens[i] for i in out) == data
    assert out == other.encode_ordinary(data.decode())


def test_bytes_that_are_no_text(spark):
    data = [b"ab\xff\xc3 cd", b"\xa9 next", b"\xe6\x97", b"fine \xc3\xa9", b"\x80" * 50]
    docs = spark.createDataFrame(list(enumerate(map(bytearray, data))), "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text").coalesce(1)
    tokens = bpe.load_merges(PATH).tokens
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs, PATH).collect()}
    assert {i: b"".join(tokens[t] for t in r["tokens"]) for i, r in rows.items()} == dict(enumerate(data))
    assert all(r["round_trip"] for r in rows.values())


def test_a_long_document_equals_its_parts(spark, other):
    text = "der Weg ist weit, il s'en va; 12345 %% \n" * 70_000  # longer than a slice
    (r,) = bpe.encode_documents(table(spark, [text]), PATH).collect()
    assert r["round_trip"] and r["tokens"] == other.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["th", "e", "ing", "a", "on", "q", "er", " ", "é", "12", "!", "ment", "zz"]), min_size=1, max_size=9).map("".join) | st.text(min_size=1, max_size=8))
def test_short_pieces_equal_the_definition(text):
    m = bpe.load_merges(PATH)
    data = text.encode("utf-8", "surrogatepass")[: bpe.SHORT_PIECE]
    e = bpe.Encoder(m)
    assert list(m.whole(data)) == m.merge(data) == e.feed(data) + e.finish()
