"""Operator 2, secret scans: all rules as one automaton, one pass over the bytes.

What the rules' matches begin with is compiled together by subset construction and minimised
into one transition array; every text is read once, many chunks at a time. Only where the
automaton accepts is the whole rule tried: a beginning's start is found with its reversed
automaton, the longest end with the rule's own. Matches of one rule don't overlap: the
leftmost comes first, of those the longest. Rules are over bytes; a match begins at the start
of the text or after a byte outside INNER, letters and digits, so that a key may follow a path
or joiner. An assigned secret's keyword may be any part of a name (DB_PASSWORD, SECRET_KEY).
A private key goes to its END line; where that is missing, over the body lines there are.

Defined results: a null or empty text has no finding; a null doc_id stays null; repeated
rows are each scanned; other columns are ignored (`find_secrets`) or kept (`redact`).
"""
from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from skein.llm import automata
from skein.llm.common import map_rows, map_texts, slices, text_buffers, with_separators

INNER = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_KEY = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_LINE = r"[ \t]*(?:(?:\r|\n|\\r|\\n)[ \t>]*)+(?:(?:-?[A-Za-z])+:(?:-?[\t -,.-\[\]-~])*|[A-Za-z0-9+/=]+)"  # a header field or base64, after a line end or an escaped one
RULES: dict[str, str] = {
    "assigned_secret": r"""(?i)[A-Za-z0-9_.-]*(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[A-Za-z0-9_.-]*["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9/+_.-]{16,}""",
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "gitlab_token": r"glpat-[A-Za-z0-9_-]{20,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": rf"-----BEGIN {_KEY}(?:(?:-?[\t\n\r -,.-~])*-----END {_KEY}|(?:{_LINE})*)",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"[sr]k_live_[0-9A-Za-z]{24,}",
    "url_credentials": r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!$%^&*+-]{3,}@",
}
FINDINGS = "doc_id long, rule string, start_byte long, n_bytes long, fingerprint string"
SLICE_BYTES = 8 << 20


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.names = list(rules)
        patterns = list(rules.values())
        self.all = automata.compile_rules(patterns, INNER, heads=True)
        self.back = [automata.compile_rules([p], anchored=True, backwards=True, heads=True) for p in patterns]
        self.ahead = [automata.compile_rules([p], anchored=True) for p in patterns]
        self.sinks = [(automata.sink(b), automata.sink(a)) for b, a in zip(self.back, self.ahead)]

    def _starts(self, k: int, data: np.ndarray, ends: list[int], low: int) -> list[tuple[int, int]]:
        """(leftmost start, not below low, of a beginning of rule k; its end) for each end that has one."""
        m, out = self.back[k], []
        path: dict[tuple[int, int], int] = {}  # where an earlier way back came by in the same state, the rest is known
        leftmost: list[int] = []
        for n, end in enumerate(ends):
            found, state = -1, m.start
            for i in range(end - 1, low - 1, -1):
                state = int(m.trans[state + int(m.byte_class[data[i]])])
                way = path.setdefault((i, state), n)
                if way != n:
                    if 0 <= leftmost[way] <= i:
                        found = leftmost[way]
                    break
                if state == self.sinks[k][0]:
                    break
                if state < m.flagged and (i == 0 or data[i - 1] not in INNER):
                    found = i
            leftmost.append(found)
            if found >= 0:
                out.append((found, end))
        return out

    def _longest(self, k: int, data: np.ndarray, start: int) -> int:
        m, found = self.ahead[k], start
        state = m.start
        for i in range(start, len(data)):
            state = int(m.trans[state + int(m.byte_class[data[i]])])
            if state == self.sinks[k][1]:
                break
            if state < m.flagged:
                found = i + 1
        return found

    def matches(self, k: int, data: np.ndarray, ends: list[int]) -> list[tuple[int, int]]:
        """Non-overlapping (start, end) of rule k, given all positions where a beginning can end."""
        out, cur, failed = [], 0, -1
        todo = self._starts(k, data, ends, 0)
        heapq.heapify(todo)
        while todo:
            s, end = heapq.heappop(todo)
            if s < cur:  # one match went over the start; the beginnings left may have later ones
                late = [end]
                while todo and todo[0][0] < cur:
                    late.append(heapq.heappop(todo)[1])
                for x in self._starts(k, data, sorted(e for e in late if e > cur), cur):
                    heapq.heappush(todo, x)
            elif s != failed:
                t = self._longest(k, data, s)
                if t > s:
                    out.append((s, t))
                    cur = t
                else:
                    failed = s
        return out

    def scan(self, offsets: np.ndarray, raw: np.ndarray):
        """(row, rule number, start, end) of every finding, in that order."""
        for i, j in slices(offsets, SLICE_BYTES):
            off = offsets[i: j + 1]
            buf, starts = with_separators(off - off[0], raw[off[0]: off[-1]])
            states = automata.scan(self.all, buf)
            at = np.flatnonzero(states < self.all.flagged)
            if not len(at):
                continue
            masks = self.all.accepts[states[at] // self.all.classes]
            rows = np.searchsorted(starts, at, side="right") - 1
            ends: dict[tuple[int, int], list[int]] = {}
            for p, mask, r in zip((at - starts[rows] + 1).tolist(), masks, rows.tolist()):
                k = 0
                while mask:
                    if mask & 1:
                        ends.setdefault((r, k), []).append(p)
                    mask >>= 1
                    k += 1
            for (r, k), e in sorted(ends.items()):
                data = buf[starts[r]: starts[r + 1] - 1]
                for s, t in self.matches(k, data, e):
                    yield i + r, k, s, t


@lru_cache(maxsize=4)
def scanner(rules: tuple[tuple[str, str], ...]) -> Scanner:
    """Compiled once in each process: it takes some tenths of a second."""
    return Scanner(dict(rules))


def find_secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: doc_id, rule, byte offset and length, md5 of the matched bytes."""
    key = tuple((rules or RULES).items())

    def run(batches):
        sc = scanner(key)
        for b in batches:
            off, raw = text_buffers(b.column(1))
            found = list(sc.scan(off, raw))
            ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            prints = [hashlib.md5(raw[off[r] + s: off[r] + t].tobytes()).hexdigest() for r, _, s, t in found]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([sc.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] - f[2] for f in found], pa.int64()), pa.array(prints, pa.string())],
                names=["doc_id", "rule", "start_byte", "n_bytes", "fingerprint"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, FINDINGS)


def redact(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The same rows and columns, each finding in text replaced by <secret:rule>.

    Overlapping findings of several rules are replaced as one, under the first rule's name.
    n_chars, if there is one, is counted anew for the rows that change.
    """
    key = tuple((rules or RULES).items())
    names = docs.columns
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        sc = scanner(key)
        for b in batches:
            off, raw = text_buffers(b.column(at_text))
            by_row: dict[int, list[tuple[int, int, int]]] = {}
            for r, k, s, t in sc.scan(off, raw):
                by_row.setdefault(r, []).append((s, t, k))
            if not by_row:
                yield b
                continue
            new: dict[int, str] = {}
            for r, spans in by_row.items():
                data, out, cur = raw[off[r]: off[r + 1]].tobytes(), [], 0
                for s, t, k in sorted(spans):
                    if s >= cur:
                        out += [data[cur:s], f"<secret:{sc.names[k]}>".encode()]
                    cur = max(cur, t)
                new[r] = (b"".join(out) + data[cur:]).decode("utf-8", "replace")
            columns = list(b.columns)
            mask = np.zeros(b.num_rows, bool)
            rows = sorted(new)
            mask[rows] = True
            texts = pa.array([new[r] for r in rows], columns[at_text].type)
            columns[at_text] = pa.compute.replace_with_mask(columns[at_text], pa.array(mask), texts)
            if at_chars is not None:
                chars = pa.array([len(new[r]) for r in rows]).cast(columns[at_chars].type)
                columns[at_chars] = pa.compute.replace_with_mask(columns[at_chars], pa.array(mask), chars)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_rows(docs, run)


def oracle_sql(rules: dict[str, str] | None = None) -> str:
    """The same findings in DuckDB: an explicit left boundary, offsets from the pieces between."""
    inner = r"[^a-zA-Z0-9]"
    parts = []
    for name, core in (rules or RULES).items():
        flag = "(?i)" if core.startswith("(?i)") else ""
        full = (flag + inner + "(" + core.removeprefix("(?i)") + ")").replace("'", "''")
        parts.append(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(t, '{full}', 0) AS m, regexp_extract_all(t, '{full}', 1) AS c, regexp_split_to_array(t, '{full}') AS p FROM d WHERE regexp_matches(t, '{full}')")
    return f"""WITH d AS (SELECT doc_id, chr(10) || text AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, rule, m, c, p, unnest(range(1, len(c) + 1)) AS i FROM f)
SELECT doc_id, rule,
  CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) + strlen(m[i]) - strlen(c[i]) - 1 AS BIGINT) AS start_byte,
  CAST(strlen(c[i]) AS BIGINT) AS n_bytes, md5(c[i]) AS fingerprint FROM u"""
