"""Deterministic automata over bytes and a lockstep scanner for them.

`compile_rules` turns regexes into one minimised transition table (subset construction,
then partition refinement). `suffix_automaton` builds the factor automaton of a byte
sequence. `scan` runs any such table over a buffer: the buffer is cut into equal chunks
that advance together as numpy lanes, each first from the start state; then every chunk
whose predecessor ended elsewhere is run again from the true state until both runs meet,
so that the result equals that of one sequential pass.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from skein.llm.common import SEPARATOR

ALL = frozenset(range(255))  # 255 is the separator
DIGIT = frozenset(b"0123456789")
WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
SPACE = frozenset(b"\t\n\f\r ")
CHUNK = 1024


# ---- regex -> syntax tree ---------------------------------------------------------------
class _Parser:
    """Literals, escapes, classes, groups, alternation, ? * + {m} {m,} {m,n} and a leading (?i)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.s = (pattern[4:] if self.fold else pattern).encode()
        self.i = 0

    def parse(self):
        node = self._alt()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced pattern at byte {self.i}")
        return node

    def _peek(self):
        return self.s[self.i: self.i + 1]

    def _alt(self):
        parts = [self._seq()]
        while self._peek() == b"|":
            self.i += 1
            parts.append(self._seq())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _seq(self):
        parts = []
        while self._peek() not in (b"", b"|", b")"):
            parts.append(self._repeat(self._atom()))
        return ("seq", parts)

    def _repeat(self, node):
        while (c := self._peek()) in (b"?", b"*", b"+", b"{") and c:
            self.i += 1
            if c == b"{":
                end = self.s.index(b"}", self.i)
                lo, _, hi = self.s[self.i: end].decode().partition(",")
                comma = b"," in self.s[self.i: end]
                self.i = end + 1
                lo = int(lo or 0)
                node = ("rep", node, lo, (int(hi) if hi else None) if comma else lo)
            else:
                node = ("rep", node, int(c == b"+"), 1 if c == b"?" else None)
        return node

    def _atom(self):
        c = self._peek()
        self.i += 1
        if c == b"(":
            if self.s[self.i: self.i + 2] == b"?:":
                self.i += 2
            node = self._alt()
            if self._peek() != b")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == b"[":
            return self._set(self._class())
        if c == b".":
            return ("set", ALL - {10})
        if c == b"\\":
            return self._set(self._escape())
        return self._set(frozenset(c))

    def _set(self, chars):
        if self.fold:
            chars = chars | {b + 32 for b in chars if 65 <= b <= 90} | {b - 32 for b in chars if 97 <= b <= 122}
        return ("set", frozenset(chars))

    def _escape(self):
        c = self._peek()
        self.i += 1
        named = {b"d": DIGIT, b"w": WORD, b"s": SPACE, b"D": ALL - DIGIT, b"W": ALL - WORD, b"S": ALL - SPACE}
        plain = {b"n": b"\n", b"t": b"\t", b"r": b"\r"}
        return named.get(c) or frozenset(plain.get(c, c))

    def _class(self):
        negate = self._peek() == b"^"
        self.i += negate
        found, first = set(), True
        while first or self._peek() != b"]":
            first = False
            c = self._peek()
            self.i += 1
            if c == b"\\":
                got = self._escape()
            else:
                got = frozenset(c)
            if len(got) == 1 and self._peek() == b"-" and self.s[self.i + 1: self.i + 2] != b"]":
                self.i += 1
                end = self._peek()
                self.i += 1
                if end == b"\\":
                    (hi,) = self._escape()
                else:
                    hi = end[0]
                got = frozenset(range(min(got), hi + 1))
            found |= got
        self.i += 1
        return ALL - found if negate else frozenset(found)


def _reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _reverse(node[1]), node[2], node[3])
    parts = [_reverse(p) for p in node[1]]
    return (kind, parts[::-1] if kind == "seq" else parts)


def _nullable(node) -> bool:
    kind = node[0]
    if kind == "rep":
        return node[2] == 0 or _nullable(node[1])
    return kind != "set" and (any if kind == "alt" else all)(map(_nullable, node[1]))


def _counts(node) -> bool:
    """Whether something in it can be repeated."""
    kind = node[0]
    if kind == "rep":
        return node[3] != 1 or _counts(node[1])
    return kind != "set" and any(map(_counts, node[1]))


def _head(tree):
    """What a match must begin with: up to the first repetition after a part that isn't empty."""
    parts = tree[1] if tree[0] == "seq" else [tree]
    for i in range(1, len(parts)):
        if _counts(parts[i]) and not all(map(_nullable, parts[:i])):
            return ("seq", parts[:i])
    return tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.edge: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.edge.append(None)
        return len(self.eps) - 1

    def build(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.eps[start].append(mid)
            self.edge[mid] = (node[1], end)
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                s = self.state()
                self.eps[start].append(s)
                self.eps[self.build(part, s)].append(end)
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            start = self.build(inner, start)
        if hi is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.eps[start].append(end)
        for _ in range(hi - lo):
            start = self.build(inner, start)
            self.eps[start].append(end)
        return end


@dataclass
class Machine:
    """trans[state + class] is the next state; states are premultiplied by the class count.

    States below `flagged` are those whose entry is reported; `accepts` gives, for each
    flagged state, the bit mask of the rules that end there.
    """

    trans: np.ndarray
    classes: int
    byte_class: np.ndarray
    start: int
    flagged: int
    accepts: np.ndarray

    @property
    def states(self) -> int:
        return len(self.trans) // self.classes


def compile_rules(patterns: list[str], inner: frozenset = frozenset(), anchored: bool = False, backwards: bool = False, heads: bool = False, max_states: int = 50_000) -> Machine:
    """One minimal automaton for all patterns, for matches anywhere in a text.

    inner: a match begins at the start of a text or after a byte that is not in this set.
    anchored: matches begin at the start only. backwards: for the reversed words.
    heads: for what the patterns' matches begin with (see `_head`). Rules that can begin
    inside another one's counted repetition multiply their counters into a product of
    states; heads have no counters.
    """
    nfa = _Nfa()
    start = nfa.state()
    accept_of: dict[int, int] = {}
    for k, p in enumerate(patterns):
        tree = _head(_Parser(p).parse()) if heads else _Parser(p).parse()
        s = nfa.state()
        nfa.eps[start].append(s)
        end = nfa.build(_reverse(tree) if backwards else tree, s)
        accept_of[end] = accept_of.get(end, 0) | 1 << k
    sets = list({e[0] for e in nfa.edge if e})
    if not anchored:
        sets.append(ALL - inner)
    member = np.zeros((256, max(1, len(sets))), bool)
    for k, s in enumerate(sets):
        member[list(s), k] = True
    kinds, byte_class = np.unique(member, axis=0, return_inverse=True)
    byte_class = byte_class.reshape(-1).astype(np.uint8)
    # the separator has a class of its own
    sep, C = len(kinds), len(kinds) + 1
    byte_class[255] = sep
    classes_of = {s: sorted(set(byte_class[list(s)].tolist())) for s in sets}

    closure: dict[int, int] = {}

    def close(q: int) -> int:
        if q not in closure:
            seen, stack = {q}, [q]
            while stack:
                for r in nfa.eps[stack.pop()]:
                    if r not in seen:
                        seen.add(r)
                        stack.append(r)
            mask = 0
            for r in seen:
                if nfa.edge[r] or r in accept_of:
                    mask |= 1 << r
            closure[q] = mask
        return closure[q]

    def bits(mask: int):
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def step(mask: int) -> list[int]:
        out = [0] * C
        for q in bits(mask):
            if nfa.edge[q]:
                s, to = nfa.edge[q]
                m = close(to)
                for c in classes_of[s]:
                    out[c] |= m
        return out

    first = close(start)
    opens = [] if anchored else classes_of[ALL - inner]
    index, todo, rows, accept = {first: 0}, [first], [], []
    while todo:
        mask = todo.pop()
        row = step(mask)
        for c in opens:
            row[c] |= first
        row[sep] = first if not anchored else 0
        here = []
        for m in row:
            if m not in index:
                index[m] = len(index)
                todo.append(m)
                if len(index) > max_states:
                    raise ValueError("the rules need too many states")
            here.append(index[m])
        rows.append((index[mask], here))
        accept.append((index[mask], sum(accept_of[q] for q in accept_of if mask >> q & 1)))
    n = len(index)
    table = np.zeros((n, C), np.int64)
    for k, r in rows:
        table[k] = r
    # a match of no byte is none
    masks = [0] * n
    for k, a in accept:
        masks[k] = a
    if not anchored:
        masks = [m & ~masks[0] for m in masks]
    return _minimise(table, masks, byte_class, 0)


def _minimise(table: np.ndarray, masks: list[int], byte_class: np.ndarray, start: int) -> Machine:
    kinds = {m: k for k, m in enumerate(dict.fromkeys(masks))}
    label = np.array([kinds[m] for m in masks])
    while True:
        sig = np.column_stack([label, label[table]])
        _, new = np.unique(sig, axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == label.max():
            break
        label = new
    n, C = int(label.max()) + 1, table.shape[1]
    rep = np.zeros(n, np.int64)
    rep[label[::-1]] = np.arange(len(label))[::-1]
    accepting = np.array([masks[r] != 0 for r in rep])
    order = np.argsort(~accepting, kind="stable")  # flagged states first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    trans = place[label[table[rep[order]]]] * C
    k = int(accepting.sum())
    return Machine(trans.astype(np.int32).reshape(-1), C, byte_class, int(place[label[start]]) * C, k * C, np.array([masks[r] for r in rep[order[:k]]], object))


def suffix_automaton(text: np.ndarray, byte_class: np.ndarray, classes: int) -> Machine:
    """The automaton of all factors of `text` (class ids), made total for cross-parsing.

    Where a factor can't be extended, the next phrase begins with the symbol at hand: the
    transition goes to the flagged copy of that symbol's state, so entries of flagged
    states count phrases. Class classes-1 is the separator and returns to the start.
    """
    C = classes
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    n = len(nxt)
    total = np.empty((C + n, C), np.int32)  # rows 0..C-1: a phrase has just begun with that symbol
    total[:, :] = np.arange(C, dtype=np.int32)
    flat = np.array([(C + s, c, C + t) for s, d in enumerate(nxt) for c, t in d.items()], np.int64).reshape(-1, 3)
    total[flat[:, 0], flat[:, 1]] = flat[:, 2]
    for c, t in nxt[0].items():
        total[c] = total[C + t]
    total[C] = np.arange(C, dtype=np.int32)  # from the start, any symbol begins a phrase
    total[:, C - 1] = C
    return Machine((total * C).reshape(-1), C, byte_class, C * C, C * C, np.zeros(0, object))


def class_grid(m: Machine, buf: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The classes of a buffer that ends with a separator, one chunk in each column."""
    lanes = max(1, -(-len(buf) // chunk))
    padded = np.full(lanes * chunk, SEPARATOR, np.uint8)
    padded[: len(buf)] = buf
    return np.ascontiguousarray(m.byte_class[padded].reshape(lanes, chunk).T)


def scan(m: Machine, buf: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state entered by each byte of a buffer that ends with a separator."""
    return run_grid(m, class_grid(m, buf, chunk), states=True)[: len(buf)]


def scan_flags(m: Machine, grid: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the n bytes of the grid entered a flagged state."""
    return run_grid(m, grid, states=False)[:n]


def run_grid(m: Machine, grid: np.ndarray, states: bool) -> np.ndarray:
    chunk, lanes = grid.shape
    trans = m.trans
    out = np.empty((chunk, lanes), np.int32 if states else bool)
    idx = np.empty(lanes, np.int64)
    state = np.full(lanes, m.start, np.int32)
    for t in range(chunk):
        np.add(state, grid[t], out=idx, casting="unsafe")
        state = trans.take(idx)
        if states:
            out[t] = state
        else:
            np.less(state, m.flagged, out=out[t])
    ends = state
    assumed = np.full(lanes, m.start, np.int32)
    while True:
        true = np.concatenate(([np.int32(m.start)], ends[:-1]))
        at = np.flatnonzero(true != assumed)
        if not len(at):
            break
        a, b = assumed[at], true[at]
        assumed[at] = b
        for t in range(chunk):
            row = grid[t, at]
            a, b = trans.take(a + row), trans.take(b + row)
            out[t, at] = b if states else b < m.flagged
            apart = a != b
            if not apart.all():
                at, a, b = at[apart], a[apart], b[apart]
                if not len(at):
                    break
        if len(at):
            ends = ends.copy()
            ends[at] = b
    return out.T.reshape(-1)


def sink(m: Machine) -> int:
    """The state that no byte leaves, or -1."""
    table = m.trans.reshape(-1, m.classes)
    stuck = np.flatnonzero((table == (np.arange(len(table)) * m.classes)[:, None]).all(axis=1))
    stuck = stuck[stuck * m.classes >= m.flagged]
    return int(stuck[0]) * m.classes if len(stuck) else -1


def walk(m: Machine, state: int, data: np.ndarray | bytes):
    """The states entered while reading data, one by one."""
    trans, cls = m.trans, m.byte_class
    for b in data:
        state = int(trans[state + int(cls[b])])
        yield state
