import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import automata
from skein.llm.common import with_separators


def buffer(texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    return with_separators(off, np.frombuffer(b"".join(raw), np.uint8))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abAB01=-_ é", max_size=60), min_size=1, max_size=6), st.sampled_from([3, 7, 64]))
def test_scan_in_chunks_equals_one_pass(texts, chunk):
    m = automata.compile_rules([r"ab{2,}[01]+", r"(?i)a=b?", r"-[^ a]{3}"], frozenset(b"ab01"))
    buf, _ = buffer(texts)
    got = automata.scan(m, buf, chunk)
    assert got.tolist() == list(automata.walk(m, m.start, buf))


def test_rules_end_where_a_regex_engine_ends_them():
    rules = [r"a(?:bc|bd)+", r"[x-z]{2,3}", r"\d\d?"]
    inner = frozenset(b"abcdxyz0123456789")
    m = automata.compile_rules(rules, inner)
    for text in ["abcbd", "qabc xyz yz", "12 3 a", "xa xyzz", ""]:
        buf, _ = buffer([text])
        states = automata.scan(m, buf)
        for k, rule in enumerate(rules):
            expected = {i + n for i in range(len(text)) if i == 0 or ord(text[i - 1]) not in inner for n in range(1, len(text) - i + 1) if re.fullmatch(rule, text[i: i + n])}
            got = {i + 1 for i in np.flatnonzero(states < m.flagged) if m.accepts[states[i] // m.classes] >> k & 1}
            assert got == expected, (text, rule)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=60), st.text(alphabet="abcd", max_size=80))
def test_cross_parsing_counts_longest_matches(sample, text):
    classes = np.zeros(256, np.uint8)
    for k, c in enumerate(b"abcd"):
        classes[c] = k
    classes[255] = 4
    m = automata.suffix_automaton(classes[np.frombuffer(sample.encode(), np.uint8)], classes, 5)
    buf, _ = buffer([text])
    flags = automata.scan_flags(m, automata.class_grid(m, buf, 8), len(buf))
    i = phrases = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i: j + 1] in sample:
            j += 1
        i, phrases = j, phrases + 1
    assert int(flags.sum()) == phrases
