"""Operator 4, personal data by a skip-chain conditional random field.

Tokens are words, numbers and single signs. A linear chain joins neighbours; skip edges
join each token that holds a digit or letter with the next equal token of the document and
with the next one of the same shape after the same sign or word. Loopy message passing
alternates exact forward-backward passes over the chains with messages over the skip edges
until a document's messages change by less than `TOLERANCE` (at most `ROUNDS` times), so
that what is said of a token in a clear context carries over to all its repetitions. Each
document stops for itself: its result doesn't depend on which others are read with it.

Only tokens within `REACH` of a digit or an at sign, or in one unspaced run with such a
token, can have a label other than O; the rest is O with certainty and parts the chain into
segments. The model is trained here, on generated sentences whose labels are known
(`TRAIN_SENTENCES`, fixed seed): the chain's weights by the likelihood, then the weights of
the two sorts of skip edges by the gradient of the likelihood under message passing, which
is the agreement of linked tokens in the data less that expected by the model.

Defined results: null and empty texts have no entity; a null doc_id stays null; repeated
rows are each read; whole texts are read. Other columns are ignored.
"""
from __future__ import annotations

import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import map_texts, slices, text_buffers, with_separators
from skein.llm.tokens import BLANK, WORDY, hash_spans, mix

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN")
REACH, ROUNDS, TOLERANCE = 8, 50, 1e-4
TRAIN_SENTENCES, EPOCHS, SKIP_EPOCHS, SEED = 1_500, 100, 12, 5
RESULT = "doc_id long, label string, start_byte long, n_bytes long, probability double"
SLICE_BYTES = 4 << 20

SIGNS = {ord(c): 12 + k for k, c in enumerate("@.-()+_:/")}
OTHER, EDGE = 21, 22
CLASSES, AROUND, EXTRA = 23, 3, 18
FEATURES = (2 * AROUND + 1) * CLASSES + EXTRA


def tokenize(buf: np.ndarray, starts: np.ndarray):
    """(start, end, row) of all tokens."""
    wordy = WORDY[buf]
    sign = ~wordy & ~BLANK[buf]
    first = wordy.copy()
    first[1:] &= ~wordy[:-1]
    last = wordy.copy()
    last[:-1] &= ~wordy[1:]
    s = np.flatnonzero(first | sign)
    e = np.flatnonzero(last | sign) + 1
    return s, e, np.searchsorted(starts, s, side="right") - 1


def describe(buf, s, e, row):
    """(class, gap before, digits) of each token."""
    digit = (buf >= 48) & (buf <= 57)
    count = np.concatenate(([0], np.cumsum(digit)))
    digits, size = count[e] - count[s], e - s
    kind = np.where(digits == 0, 0, np.where(size >= 16, 2, 1))
    pure = digits == size
    kind[pure] = np.select([size[pure] == 1, size[pure] == 2, size[pure] == 3, size[pure] == 4, size[pure] <= 8, size[pure] <= 12, size[pure] <= 19], [3, 4, 5, 7, 8, 9, 10], 11)
    three = np.flatnonzero(kind == 5)
    value = sum((buf[s[three] + k].astype(np.int64) - 48) * 10 ** (2 - k) for k in range(3))
    kind[three[value > 255]] = 6
    sign = ~WORDY[buf[s]]
    kind[sign] = OTHER
    for c, k in SIGNS.items():
        kind[sign & (buf[s] == c)] = k
    gap = np.ones(len(s), bool)
    gap[1:] = (s[1:] > e[:-1]) | (row[1:] != row[:-1])
    return kind, gap, digits


def segments_of(kind, digits, row, gap):
    """(tokens, where each segment begins among them, sizes): the runs of tokens near a digit or at sign, within one document."""
    n = len(kind)
    hot = (digits > 0) | (kind == 12)
    at = np.flatnonzero(hot)
    mark = np.zeros(n + 1, np.int64)
    begins = np.append(np.flatnonzero(gap), n)  # of unspaced runs
    run = np.searchsorted(begins, at, side="right") - 1
    low = np.minimum(np.maximum(at - REACH, np.searchsorted(row, row[at], side="left")), begins[run]) if len(at) else at
    high = np.maximum(np.minimum(at + REACH + 1, np.searchsorted(row, row[at], side="right")), begins[run + 1]) if len(at) else at
    np.add.at(mark, low, 1)
    np.add.at(mark, high, -1)
    inside = np.cumsum(mark[:n]) > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(begin)
    tokens = np.flatnonzero(inside)
    place = np.searchsorted(tokens, start)
    return tokens, place, np.diff(np.append(place, len(tokens)))


def features(kind, gap, digits, seg):
    """The binary features of each token; seg: the number of its segment."""
    n = len(kind)
    x = np.zeros((n, FEATURES), np.float32)
    at = np.arange(n)
    for d in range(-AROUND, AROUND + 1):
        j = np.clip(at + d, 0, n - 1)
        same = (at + d == j) & (seg[j] == seg)
        x[at, (d + AROUND) * CLASSES + np.where(same, kind[j], EDGE)] = 1
    base = (2 * AROUND + 1) * CLASSES
    new = gap.copy()  # a run without blanks and without signs that no value is made of
    new[1:] |= (seg[1:] != seg[:-1]) | (kind[1:] == OTHER) | (kind[:-1] == OTHER)
    new[:1] = True
    chunk = np.cumsum(new) - 1
    total = lambda m: np.bincount(chunk, weights=m, minlength=int(chunk[-1]) + 1 if n else 0)[chunk]
    ats, dots, nums = total(kind == 12), total(kind == 13), total(digits > 0)
    letters, small = total((kind <= 2)), total((kind >= 3) & (kind <= 5))
    before_at = np.zeros(n, bool)
    if n:
        seen = np.cumsum(kind == 12)
        before_at = (ats > 0) & (seen - (seen[np.flatnonzero(new)] - (kind[np.flatnonzero(new)] == 12))[chunk] == 0)
    x[:, base] = gap
    x[:, base + 1] = np.append(new[1:], True)[:n]
    x[:, base + 2] = np.concatenate(([True], new[:-1]))[:n]
    x[1:, base + 2][seg[1:] != seg[:-1]] = 1
    x[:, base + 3] = ats == 1
    x[:, base + 4] = (ats == 1) & (dots > 0)
    x[:, base + 5] = before_at
    x[:, base + 6] = (small == 4) & (nums == 4) & (dots >= 3) & (letters == 0)
    x[:, base + 7] = (nums == 1) & (letters == 0)
    x[:, base + 8] = (dots > 0) & (nums > 0) & (nums != 4)
    c = np.concatenate(([0], np.cumsum(digits)))
    edges = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if n else np.zeros(0, np.int64)
    lo = np.maximum(at - 7, edges[np.searchsorted(edges, at, side="right") - 1]) if n else at
    hi = np.minimum(at + 8, np.append(edges, n)[np.searchsorted(edges, at, side="right")]) if n else at
    near = c[hi] - c[lo]
    for k, (a, b) in enumerate(((0, 7), (7, 10), (10, 14), (14, 20), (20, 10**9))):
        x[:, base + 9 + k] = (near >= a) & (near < b)
    plus = np.concatenate(([0], np.cumsum(kind == 17)))
    x[:, base + 14] = plus[np.maximum(at, lo)] - plus[lo] > 0
    paren = np.concatenate(([0], np.cumsum((kind == 15) | (kind == 14))))
    x[:, base + 15] = paren[hi] - paren[lo] > 0
    x[:, base + 16] = (kind >= 3) & (kind <= 11)
    x[:, base + 17] = 1
    return x


def forward_backward(unary, gap, place, size, trans, pairs=False):
    """Marginals of each token, and expected transitions (2, L, L) if asked for."""
    n, L = unary.shape
    psi = np.exp(unary - unary.max(axis=1, keepdims=True))
    psi /= psi.sum(axis=1, keepdims=True)
    move = np.exp(trans)
    order = np.argsort(-size, kind="stable")
    start, size = place[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    alpha, beta = np.empty((n, L)), np.ones((n, L))
    step = lambda a, g, m: np.where(g[:, None], a @ m[1], a @ m[0])
    for t in range(longest):
        i = start[: active[t]] + t
        a = psi[i] if t == 0 else step(alpha[i - 1], gap[i], move) * psi[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    back = move.transpose(0, 2, 1)
    for t in range(longest - 1, 0, -1):
        i = start[: active[t]] + t
        b = step(beta[i] * psi[i], gap[i], back)
        beta[i - 1] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p, None
    inner = np.ones(n, bool)
    inner[place] = False
    i = np.flatnonzero(inner)
    expected = np.zeros((2, L, L))
    for g in (0, 1):
        j = i[gap[i] == bool(g)]
        q = alpha[j - 1][:, :, None] * move[g] * (psi[j] * beta[j])[:, None, :]
        expected[g] = (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, expected


def skip_edges(h, kind, size, doc, place):
    """(from, to, sort): consecutive equal tokens (0) and tokens of one shape and context (1); place: where segments begin."""
    out = []
    use = np.flatnonzero(kind <= 11)
    before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
    before[place] = 0
    shape = mix(before + np.uint64(31) * kind.astype(np.uint64) + np.uint64(977) * size.astype(np.uint64))
    for sort, key in ((0, h), (1, shape)):
        at = use if sort == 0 else use[kind[use] >= 3]
        o = at[np.lexsort((at, key[at], doc[at]))]
        same = (key[o[1:]] == key[o[:-1]]) & (doc[o[1:]] == doc[o[:-1]])
        a, b = o[:-1][same], o[1:][same]
        out.append(np.column_stack([a, b, np.full(len(a), sort)]))
    return np.concatenate(out)


class Crf:
    def __init__(self, weights, trans, skip):
        self.weights, self.trans, self.skip = weights, trans, skip

    def marginals(self, x, gap, place, size, edges, doc=None):
        """The label probabilities of each token; doc: its document (one for all, if not given)."""
        return self._propagate(x, gap, place, size, edges, np.zeros(len(x), np.int64) if doc is None else doc)[0]

    def _propagate(self, x, gap, place, size, edges, doc):
        """(marginals, for each edge the probability that both ends agree were they not linked)."""
        unary = (x @ self.weights.astype(np.float32)).astype(np.float64)
        p, _ = forward_backward(unary, gap, place, size, self.trans)
        m, L = len(edges), len(LABELS)
        if not m:
            return p, np.zeros(0)
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        gain = np.expm1(np.concatenate([self.skip[edges[:, 2]]] * 2))[:, None]
        message = np.full((2 * m, L), 1 / L)
        cavity = np.empty((2 * m, L))
        alive = np.zeros(int(doc.max()) + 1, bool)
        alive[doc[a]] = True
        for _ in range(ROUNDS):
            e = np.flatnonzero(alive[doc[a]])
            t = np.flatnonzero(alive[doc])
            cavity[e] = p[a[e]] / message[(e + m) % (2 * m)]
            cavity[e] /= cavity[e].sum(axis=1, keepdims=True)
            new = 1 + gain[e] * cavity[e]
            new /= new.sum(axis=1, keepdims=True)
            moved = np.abs(new - message[e]).max(axis=1)
            message[e] = new
            coming = np.column_stack([np.bincount(b[e], weights=w, minlength=len(x)) for w in np.log(new).T])
            some = alive[doc[place]]
            sizes = size[some]
            p[t], _ = forward_backward(unary[t] + coming[t], gap[t], np.cumsum(sizes) - sizes, sizes, self.trans)
            alive[:] = False
            alive[doc[a[e[moved >= TOLERANCE]]]] = True
            if not alive.any():
                break
        return p, (cavity[:m] * cavity[m:]).sum(axis=1)


def _read(raw_texts: list[bytes]):
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw_texts]))).astype(np.int64)
    return with_separators(off, np.frombuffer(b"".join(raw_texts), np.uint8))


def prepare(buf, starts):
    """Everything inference needs about the tokens near digits and at signs."""
    s, e, row = tokenize(buf, starts)
    kind, gap, digits = describe(buf, s, e, row)
    tokens, place, size = segments_of(kind, digits, row, gap)
    s, e, row, kind, gap, digits = (v[tokens] for v in (s, e, row, kind, gap, digits))
    seg = np.repeat(np.arange(len(place)), size)
    h = hash_spans(buf, s, e)
    return s, e, row, kind, gap, place, size, features(kind, gap, digits, seg), skip_edges(h, kind, e - s, row, place)


# ---- training sentences -----------------------------------------------------------------
def _sentence(rng) -> tuple[bytes, list[tuple[int, int, int]]]:
    """A text and the (start, end, label) of what is planted in it."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    syllables = ["th", "er", "on", "an", "re", "st", "ing", "ción", "é", "keit", "ü", "la", "os", "in", "ment", "ß", "ou", "ä", "ba", "ko"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def email():
        plain = lambda: word().encode("ascii", "ignore").decode() or "x"
        local = pick([word(), word() + "." + num(2), word() + "_" + word(), word() + num(1), word() + "+" + word(), num(3) + word(), word() + "-" + word() + "." + word(), ".".join(word() for _ in range(int(rng.integers(2, 6))))])
        end = pick(["com", "org", "net", "co.uk", "de", "io", "edu", "ac.jp"])
        host = pick([f"mail{num(1)}.{plain()}.{end}", f"{plain()}.{end}", f"mx.{plain()}{num(2)}.{end}", f"{plain()}-{plain()}.{end}", f"{plain()}.{plain()}.{plain()}.{end}", f"{plain()}{num(1)}-{plain()}.{plain()}.{end}"])
        return local + "@" + host

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {num(2)} {num(7)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+34 {num(3)} {num(3)} {num(3)}", f"+1 ({a}) 555-{c}"])

    def ip():
        return ".".join(str(int(v)) for v in rng.integers(0, 256, 4))

    def card():
        return pick([num(16), num(16), num(16), " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4)), num(15)])

    def plain():
        return pick([f"{num(1)}.{num(1)}", num(1), num(2), "20" + num(2), f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}:{num(2)}", f"{num(3)} {num(4)}", f"{num(2)} {num(3)} {num(2)}", f"${num(2)}.{num(2)}", f"{num(2)}:{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(1)},{num(3)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(3)}.{num(3)}", num(6), num(5), f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"({num(1)})", f"+{num(1)}", f"{num(1)}-{num(1)}", f"{num(2)}%",
                     'token = "' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', "key=" + "".join(pick(string.ascii_letters + string.digits) for _ in range(20)), word() + num(2), "@" + word(), word() + " @ " + word(), f"v{num(1)}.{num(1)}", num(8), "300.400.500.600", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(3)}", num(22)])

    # signs that stand beside words and values: any but those that values are made of
    signs = [c for c in string.punctuation if ord(c) not in SIGNS]
    noise = lambda: pick(signs) * int(rng.integers(1, 5))
    makers = {1: email, 2: phone, 3: ip, 4: card, 5: lambda: f"{num(3)}-{num(2)}-{num(4)}"}
    out, spans, memory = "", [], []
    noisy, upper, glue = rng.random() < 0.35, rng.random() < 0.12, pick([" ", " ", " ", "\n", "\t", " | ", "; ", ";", ",", "|"])
    for _ in range(int(rng.integers(2, 6))):
        text = " ".join(word() for _ in range(int(rng.integers(0, 10))))
        if rng.random() < 0.65:
            label = int(rng.integers(1, 6))
            value = pick(memory) if memory and rng.random() < 0.25 else (label, makers[label]())
            memory.append(value)
        else:
            value = (0, plain())
        label, value = value
        if noisy:
            text = " ".join(w + noise() if rng.random() < 0.8 else w for w in text.split())
            parts = value.split(" ")
            value = "".join(p + ((noise() if rng.random() < 0.6 else "") + " " if k < len(parts) - 1 else "") for k, p in enumerate(parts))
        if upper:
            text, value = text.upper(), value.upper() if label != 0 else value
        end = noise() if noisy else pick(["", "", "", ".", ",", ";", ")", "?", "!"])
        before = pick(["", "", "", "", "(", "<", "'", '"', "=", word() + ";", word() + ","]) if not noisy and label else ""
        out += text + (" " if text else "") + before
        spans.append((len(out.encode()), len((out + value).encode()), label))
        out += value + end + glue
    return out.encode(), [x for x in spans if x[2]]


@lru_cache(maxsize=1)
def train() -> Crf:
    """Fitted once in the driver's process; some seconds."""
    rng = np.random.default_rng(SEED)
    made = [_sentence(rng) for _ in range(TRAIN_SENTENCES)]
    buf, starts = _read([t for t, _ in made])
    s, e, row, _, gap, place, size, x, edges = prepare(buf, starts)
    y = np.zeros(len(s), np.int64)
    at = s - starts[row]
    begin = np.searchsorted(row, np.arange(len(made) + 1))
    for r, (_, spans) in enumerate(made):
        a, b = begin[r], begin[r + 1]
        for lo, hi, label in spans:
            y[a:b][(at[a:b] >= lo) & (at[a:b] < hi)] = label
    L = len(LABELS)
    w, t = np.zeros((FEATURES, L)), np.zeros((2, L, L))
    inner = np.ones(len(y), bool)
    inner[place] = False
    seen = np.zeros((2, L, L))
    i = np.flatnonzero(inner)
    np.add.at(seen, (gap[i].astype(int), y[i - 1], y[i]), 1)
    hot, n = np.eye(L)[y], len(y)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, t)]
    for step in range(1, EPOCHS + 1):
        p, expected = forward_backward((x @ w.astype(np.float32)).astype(np.float64), gap, place, size, t, pairs=True)
        for v, g, (m, q) in ((w, x.T @ ((p - hot) / n).astype(np.float32) + 1e-5 * w, state[0]), (t, (expected - seen) / n + 1e-5 * t, state[1])):
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            v -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    crf = Crf(w, t, np.zeros(2))
    agree = y[edges[:, 0]] == y[edges[:, 1]]
    m, q = np.zeros(2), np.zeros(2)
    for step in range(1, SKIP_EPOCHS + 1):
        alone = crf._propagate(x, gap, place, size, edges, row)[1]
        odds = np.exp(crf.skip[edges[:, 2]]) * alone
        short = agree - odds / (odds + 1 - alone)
        g = np.array([short[edges[:, 2] == sort].mean() if (edges[:, 2] == sort).any() else 0.0 for sort in (0, 1)])
        m += 0.1 * (g - m)
        q += 0.001 * (g * g - q)
        crf.skip = crf.skip + 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return crf


def entities(crf: Crf, buf: np.ndarray, starts: np.ndarray):
    """(row, label, start, end, probability) of each entity of the texts."""
    s, e, row, kind, gap, place, size, x, edges = prepare(buf, starts)
    if not len(s):
        return []
    p = crf.marginals(x, gap, place, size, edges, row)
    label = p.argmax(axis=1)
    new = np.ones(len(s), bool)
    new[1:] = label[1:] != label[:-1]
    new[place] = True
    # an address ends at white space; so does a number in one piece; a plus begins a new one
    new |= gap & np.isin(label, (1, 3))
    whole = np.isin(kind, (10, 11))
    new[1:] |= gap[1:] & (label[1:] == 4) & (whole[1:] | whole[:-1])
    new |= gap & (label == 2) & (kind == 17)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    best = np.add.reduceat(p.max(axis=1), first) / (last - first + 1)
    found = label[first] > 0
    return [(int(row[a]), int(label[a]), int(s[a] - starts[row[a]]), int(e[b] - starts[row[a]]), float(q)) for a, b, q in zip(first[found], last[found], best[found])]


def find_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """One row per entity: doc_id, label, byte offset and length, mean probability."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or train())

    def run(batches):
        model = shared.value
        for b in batches:
            off, raw = text_buffers(b.column(1))
            rows, out = [], []
            for i, j in slices(off, SLICE_BYTES):
                o, r = off[i: j + 1] - off[i], raw[off[i]: off[j]]
                # texts without digit and at sign hold nothing
                hot = np.concatenate(([0], np.cumsum(((r >= 48) & (r <= 57)) | (r == 64))))
                some = np.flatnonzero(hot[o[1:]] > hot[o[:-1]])
                if not len(some):
                    continue
                buf, starts = _read([r[o[k]: o[k + 1]].tobytes() for k in some])
                for k, label, s, e, q in entities(model, buf, starts):
                    rows.append(i + int(some[k]))
                    out.append((LABELS[label], s, e - s, q))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64())))], names=["doc_id", "label", "start_byte", "n_bytes", "probability"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, RESULT)
