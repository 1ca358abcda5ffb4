"""Word spans and 64-bit word hashes over raw bytes, without decoding or Python strings."""
from __future__ import annotations

import numpy as np

from skein.llm.common import with_separators

WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = True
WORDY[128:255] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32, 255]] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal non-zero values."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.append(edge, n)
    real = kind[starts] != 0
    return starts[real], ends[real]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans don't overlap and are in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    data = buf[pos + np.repeat(starts, lens)]
    power = np.concatenate(([np.uint64(1)], np.full(int(lens.max()) - 1, MULTIPLIER))).cumprod(dtype=np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[pos]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def words(offsets: np.ndarray, raw: np.ndarray, symbols: bool = False, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first token of each row) of all tokens of the texts, in order.

    A token is a run of ASCII letters and digits and of bytes above them; with `symbols`,
    runs of the other visible bytes are tokens too. fold: ASCII letters in lower case.
    """
    buf, starts = with_separators(offsets, raw)
    if fold:
        upper = (buf >= 65) & (buf <= 90)
        buf = buf + (upper.astype(np.uint8) << 5)
    kind = WORDY[buf].astype(np.int8)
    if symbols:
        kind[~WORDY[buf] & ~BLANK[buf]] = 2
    s, e = runs(kind)
    first = np.searchsorted(s, starts)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    return hash_spans(buf, s, e), rows, first


def sum_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, where row r has those from first[r] to first[r + 1]."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out
