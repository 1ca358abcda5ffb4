import random
from itertools import product

import numpy as np

from skein.llm import pii
from tests.llm.util import awkward, clashing, empty, table


def test_held_out_sentences():
    crf = pii.train()
    rng = np.random.default_rng(99)
    made = [pii._sentence(rng) for _ in range(400)]
    buf, starts = pii._read([t for t, _ in made])
    got = {(r, s, e, k) for r, k, s, e, _ in pii.entities(crf, buf, starts)}
    true = {(r, *x) for r, (_, spans) in enumerate(made) for x in spans}
    hit = len(got & true)
    assert hit / len(true) > 0.96 and hit / len(got) > 0.96


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    L, n = len(pii.LABELS), 4
    unary, trans, gap = rng.normal(size=(n, L)), rng.normal(size=(2, L, L)), np.array([True, False, True, False])
    p, _ = pii.forward_backward(unary, gap, np.array([0]), np.array([n]), trans)
    expected = np.zeros((n, L))
    for y in product(range(L), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(trans[int(gap[i]), y[i - 1], y[i]] for i in range(1, n)))
        for i in range(n):
            expected[i, y[i]] += w
    assert np.allclose(p, expected / expected.sum(1, keepdims=True))


def test_skip_edge_messages_are_exact_between_two_tokens():
    rng = np.random.default_rng(5)
    L = len(pii.LABELS)
    x = np.zeros((2, pii.FEATURES), np.float32)
    x[0, 0] = x[1, 1] = 1
    weights = rng.normal(size=(pii.FEATURES, L)).astype(np.float32).astype(float)
    crf = pii.Crf(weights, np.zeros((2, L, L)), np.array([1.5, 0.7]))
    p = crf.marginals(x, np.ones(2, bool), np.array([0, 1]), np.array([1, 1]), np.array([[0, 1, 0]]))
    joint = np.exp(weights[0][:, None] + weights[1][None] + 1.5 * np.eye(L))
    joint /= joint.sum()
    assert np.allclose(p[0], joint.sum(1), atol=1e-6) and np.allclose(p[1], joint.sum(0), atol=1e-6)


def test_planted_entities_in_documents(spark):
    texts = ["Thand reing +1 (980) 555-2833 eron the", "ou eau.42@mail9.example.com envi. 53.224.140.246 er", "the 7844238401328224 x", "Licensed under the Apache License, Version 2.0.", "w " * 70_000 + "mail bo.11@mail2.example.com"]
    got = {(r["doc_id"], r["label"], r["start_byte"], r["n_bytes"]) for r in pii.find_pii(table(spark, texts)).collect()}
    assert got == {(0, "PHONE", 12, 17), (1, "EMAIL", 3, 24), (1, "IP", 34, 14), (2, "CARD", 4, 16), (4, "EMAIL", 140_005, 23)}


def test_awkward_and_empty_tables(spark):
    assert pii.find_pii(awkward(spark)).count() == 0
    assert pii.find_pii(empty(spark)).count() == 0
    twice = table(spark, ["a@b.example.com"]).unionByName(table(spark, ["a@b.example.com"]))
    assert [r["label"] for r in pii.find_pii(twice).collect()] == ["EMAIL", "EMAIL"]


def prose(seed, n):
    """Letters, forms, logs and tables as people write them, with what is personal in them; made apart from the training sentences."""
    r = random.Random(seed)
    name = lambda: r.choice(["anna", "li.wei", "j_smith", "maria-jose", "k.o.brien", "tom42", "info", "van.der.berg"])
    host = lambda: r.choice(["example.org", "mail.example.com", "uni-bonn.example.de", "corp.example.co.uk", "example.net"])
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {
        "EMAIL": lambda: f"{name()}@{host()}",
        "PHONE": lambda: r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]),
        "IP": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
        "CARD": lambda: r.choice([d(16), "-".join(d(4) for _ in range(4)), " ".join(d(4) for _ in range(4))]),
        "SSN": lambda: f"{d(3)}-{d(2)}-{d(4)}",
    }
    frames = [
        ("Dear customer, please write to {} before Friday and we will answer within {} days.", ["EMAIL", "#"]),
        ("Call me at {} or, after six, at {}; the office closes early.", ["PHONE", "PHONE"]),
        ("2021-03-04 12:10:33 INFO login from {} accepted, port 8080", ["IP"]),
        ("{} - - GET /index.html 200 5120", ["IP"]),
        ("The card {} was declined on 12/05/2019; contact {}.", ["CARD", "EMAIL"]),
        ("His number {} stands on the form, page 14 of 20.", ["SSN"]),
        ("In chapter 3.2 we compare 15 methods over 200 runs (see table 4), about 3.5% apart.", []),
        ("Version 1.4.2 costs $19.99 and weighs 250 grams.", []),
        ("name;mail;phone\nA. Smith;{};{}\n", ["EMAIL", "PHONE"]),
        ("Forwarded by <{}> to ({})", ["EMAIL", "EMAIL"]),
    ]
    texts, spans = [], []
    for i in range(n):
        text = ""
        for frame, kinds in (r.choice(frames) for _ in range(r.randint(1, 4))):
            parts = frame.split("{}")
            for k, part in enumerate(parts):
                text += part
                if k < len(kinds):
                    value = make[kinds[k]]() if kinds[k] != "#" else str(r.randint(2, 30))
                    if kinds[k] != "#":
                        spans.append((i, kinds[k], len(text.encode()), len(value)))
                    text += value
            text += r.choice([" ", "\n", "  "])
        texts.append(text)
    return texts, set(spans)


def test_texts_of_another_generator(spark):
    texts, true = prose(1, 300)
    got = {(r["doc_id"], r["label"], r["start_byte"], r["n_bytes"]) for r in pii.find_pii(table(spark, texts)).collect()}
    assert len(got & true) / len(true) > 0.9 and len(got & true) / len(got) > 0.9


def exact(crf, x, gap, place, size, edges):
    """Marginals by enumeration of the labels of all linked tokens; between them the chains are exact."""
    unary = (x @ crf.weights.astype(np.float32)).astype(np.float64)
    linked, L = sorted(set(edges[:, :2].reshape(-1).tolist())), len(pii.LABELS)
    starts = set(place.tolist())
    total, z = np.zeros(unary.shape), 0.0
    for y in product(range(L), repeat=len(linked)):
        held = np.exp(unary)
        for i, c in zip(linked, y):
            held[i] *= np.eye(L)[c]
        label = dict(zip(linked, y))
        w = np.exp(sum(crf.skip[k] for a, b, k in edges.tolist() if label[a] == label[b]))
        alpha, beta = np.zeros_like(held), np.ones_like(held)
        for i in range(len(held)):
            alpha[i] = held[i] * (1 if i in starts else alpha[i - 1] @ np.exp(crf.trans[int(gap[i])]))
        for i in range(len(held) - 1, 0, -1):
            if i not in starts:
                beta[i - 1] = np.exp(crf.trans[int(gap[i])]) @ (held[i] * beta[i])
        ends = [*sorted(starts)[1:], len(held)]
        parts = np.array([alpha[e - 1].sum() for e in ends])
        w *= parts.prod()
        segment = np.searchsorted(sorted(starts), np.arange(len(held)), side="right") - 1
        total += w * alpha * beta / np.maximum(parts[segment], 1e-300)[:, None]
        z += w
    return total / z


def test_whole_documents_equal_enumeration(spark):
    crf = pii.train()
    texts = ["call 555-21", "x 12.7 and y 12.9", "a@b.org and so with many words that are all new until far beyond these signs there comes one more line from a@c.org", "card 4444 5555 or", "at 10.0.0.1, port 80", "nothing here"]
    expected = set()
    for i, t in enumerate(texts):
        s, e, row, kind, gap, place, size, x, edges = pii.prepare(*pii._read([t.encode()]))
        if not len(s):
            continue
        assert len(set(edges[:, :2].reshape(-1).tolist())) <= 6
        p = exact(crf, x, gap, place, size, edges)
        got = crf.marginals(x, gap, place, size, edges, row)
        assert np.abs(got - p).max() < 0.05
        both = [g.argmax(axis=1).tolist() for g in (got, p)]
        assert both[0] == both[1]

        class Exact(pii.Crf):
            def marginals(self, *_):
                return p

        expected |= {(i, pii.LABELS[k], a, b - a) for _, k, a, b, _ in pii.entities(Exact(crf.weights, crf.trans, crf.skip), *pii._read([t.encode()]))}
    assert {(r["doc_id"], r["label"], r["start_byte"], r["n_bytes"]) for r in pii.find_pii(table(spark, texts)).collect()} == expected


def test_a_document_is_read_the_same_beside_others():
    crf, texts = pii.train(), [t.encode() for t in prose(3, 40)[0]]
    together = {(r, *x): q for r, *x, q in pii.entities(crf, *pii._read(texts))}
    alone = {(i, *x): q for i, t in enumerate(texts) for _, *x, q in pii.entities(crf, *pii._read([t]))}
    assert together.keys() == alone.keys()
    assert all(abs(q - alone[x]) < 1e-3 for x, q in together.items())


def test_long_addresses_are_whole_and_repetitions_agree(spark):
    long = "maria.del.carmen.garcia.lopez@mail.dept.school.ac.example.uk"
    texts = [f"write to {long} now", "reach me by phone: +1 (212) 555-0187. " + "word " * 40 + " ".join("then 212 555 0187 once more" for _ in range(12))]
    rows = pii.find_pii(table(spark, texts)).collect()
    assert ("EMAIL", 9, len(long)) in {(r["label"], r["start_byte"], r["n_bytes"]) for r in rows if r["doc_id"] == 0}
    assert pii.find_pii(clashing(spark)).count() == 0
