"""Operator 3, language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled rows: of the
`per_language` documents with the least hashes of their id, in that order, those that fit
whole into `train_bytes`; the rest are held out, up to twice as many bytes. A document that
doesn't fit is passed over, none is cut. A text is parsed
greedily against each automaton: a phrase is the longest piece that occurs in the sample,
the next one begins after it. Phrases divided by letters is the cross-parsing rate; the
language that needs fewest wins. Texts are folded to lower case; runs of bytes that are no
letters count as one space.

A text is rejected if it has no letters, or if its rate is above `reject_rate` where every
`PART_BYTES` may go to the language that needs fewest phrases for them, so that a text in
two languages is kept. The limit is set from the sample: midway between that rate of
held-out labelled text and of the same letters in shuffled order, a text of no language.
For a text of few letters the limit is raised by three standard errors, so that a short
clean text isn't lost by chance.

Defined results: null, empty and letterless texts have language null, rate null and are
rejected; equal rates go to the language first in the alphabet; repeated rows get equal
answers; whole texts are parsed, however long. A language whose sampled documents are all
longer than `train_bytes` is learned from the shortest one. Of labelled rows with one id the
least text is used. With no labelled row nothing can be known: language and rate are null
and every text is kept. Columns may have any names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import automata
from skein.llm.common import SEPARATOR, map_rows, map_texts, sample_ids, slices, text_buffers, with_separators

TRAIN_BYTES = 16_384
DOCS_PER_LANGUAGE = 48
PART_BYTES = 512
SLICE_BYTES = 6 << 20
RESULT = "doc_id long, language string, phrases long, letters long, rate double, keep boolean"

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:255] = True


def fold(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with separators, starts, letters of each text); runs of other bytes become one space."""
    buf, starts = with_separators(offsets, raw)
    letter = LETTER[buf]
    ends = starts[1:] - 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = letter[starts[:-1]]
    keep[ends] = True
    out = np.where(letter, buf, np.uint8(32))
    out[ends] = SEPARATOR
    out = out[keep]
    new_ends = np.flatnonzero(out == SEPARATOR)
    new_starts = np.concatenate(([0], new_ends + 1))
    letters = np.add.reduceat(letter[keep], new_starts[:-1], dtype=np.int64) if len(new_ends) else np.zeros(0, np.int64)
    return out, new_starts, letters


class LanguageModel:
    """One automaton per language over a shared alphabet, and the rejection limits."""

    def __init__(self, samples: dict[str, list[str]], train_bytes: int = TRAIN_BYTES):
        self.languages = sorted(samples)
        train, held = {}, {}
        for lang in self.languages:
            texts = [self._folded([t.lower().encode()]) for t in samples[lang] if t]
            fitted, rest = self._fill(texts[: max(1, len(texts) * 3 // 4)], train_bytes)
            if not fitted:
                fitted, rest = [min(texts, key=len)], []
            train[lang] = np.concatenate(fitted)
            held[lang] = np.concatenate(self._fill(texts[max(1, len(texts) * 3 // 4):] + rest, 2 * train_bytes)[0] or fitted)
        self.samples = {lang: t[t != SEPARATOR].tobytes() for lang, t in train.items()}
        used = sorted(set(np.concatenate([*train.values(), np.array([32], np.uint8)]).tolist()) - {SEPARATOR})
        self.byte_class = np.full(256, len(used), np.uint8)  # bytes seen nowhere share a class
        self.byte_class[used] = np.arange(len(used))
        self.byte_class[SEPARATOR] = len(used) + 1
        classes = len(used) + 2
        self.machines = [automata.suffix_automaton(self.byte_class[train[x][train[x] != SEPARATOR]], self.byte_class, classes) for x in self.languages]
        rng = np.random.default_rng(7)
        inside, outside = [], []
        for lang in self.languages:
            text = held[lang]
            mixed = rng.permutation(text)
            for data, out in ((text, inside), (mixed, outside)):
                buf, starts, letters = fold(np.array([0, len(data)]), np.where(data == SEPARATOR, np.uint8(32), data))
                out.append(float(self._phrases(buf, starts)[1][0] / max(1, letters[0])))
        self.inside = max(inside, default=0.0)
        self.reject_rate = (self.inside + min(outside, default=1.0)) / 2

    @staticmethod
    def _fill(texts: list[np.ndarray], room: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(those that fit whole, one after another; the others)."""
        used, rest = [], []
        for t in texts:
            (used if len(t) <= room else rest).append(t)
            room -= len(t) if len(t) <= room else 0
        return used, rest

    @staticmethod
    def _folded(texts: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return fold(off, raw)[0] if texts else np.zeros(0, np.uint8)

    def _phrases(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each language and text, phrases of each text whose parts go to their best languages)."""
        grid = automata.class_grid(self.machines[0], buf)
        parts = -(-np.diff(starts) // PART_BYTES)
        first = np.cumsum(parts) - parts
        begins = np.repeat(starts[:-1], parts) + PART_BYTES * (np.arange(int(parts.sum())) - np.repeat(first, parts))
        counts = np.stack([np.add.reduceat(automata.scan_flags(m, grid, len(buf)), begins, dtype=np.int64) for m in self.machines])
        return np.add.reduceat(counts, first, axis=1), np.add.reduceat(counts.min(axis=0), first)

    def classify(self, offsets: np.ndarray, raw: np.ndarray):
        """(language number or -1, phrases, letters, keep) of each text."""
        buf, starts, letters = fold(offsets, raw)
        if not len(letters) or not self.machines:
            none = np.zeros(len(letters), np.int64)
            return none - 1, none, letters, letters >= 0
        counts, least = self._phrases(buf, starts)
        best = counts.argmin(axis=0)
        phrases = counts.min(axis=0)
        rate = least / np.maximum(letters, 1)
        limit = self.reject_rate + 3 * np.sqrt(self.reject_rate / np.maximum(letters, 1))
        return np.where(letters > 0, best, -1), phrases, letters, (letters > 0) & (rate <= limit)


def train(docs: DataFrame, lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fits on at most per_language documents of each label; reads texts of those only."""
    ids = sample_ids(docs, lang_col, per_language)
    found: dict[str, list[str]] = {}
    if ids:
        rows = docs.where(F.col("doc_id").isin(ids) & F.col(lang_col).isNotNull() & (F.octet_length(F.trim("text")) > 0)).select(F.col(lang_col).alias("lang"), "text", F.xxhash64("doc_id").alias("h"), "doc_id")
        size = F.octet_length("text")
        one = rows.groupBy("lang", "h", "doc_id").agg(F.min(F.when(size <= train_bytes, F.col("text"))).alias("text"), F.min(F.struct(size, "text")).alias("least"))
        # a long text comes to the driver only where its language has no other
        short = F.max(F.col("text").isNotNull()).over(Window.partitionBy("lang"))
        shortest = F.row_number().over(Window.partitionBy("lang").orderBy("least", "doc_id")) == 1
        chosen = one.withColumns({"short": short, "shortest": shortest}).select("lang", "h", "doc_id", F.when(F.col("short"), F.col("text")).when(F.col("shortest"), F.col("least.text")).alias("text")).where("text IS NOT NULL")
        for r in sorted(chosen.collect(), key=lambda r: (r["h"], r["doc_id"])):
            found.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel(found, train_bytes)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, language, phrases, letters, rate, keep for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, None], object)
        for b in batches:
            off, raw = text_buffers(b.column(1))
            for i, j in slices(off, SLICE_BYTES):
                best, phrases, letters, keep = m.classify(off[i: j + 1] - off[i], raw[off[i]: off[j]])
                known = best >= 0
                rate = pa.array(phrases / np.maximum(letters, 1), mask=~known)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(phrases), pa.array(letters), rate, pa.array(keep)],
                    names=["doc_id", "language", "phrases", "letters", "rate", "keep"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"].cast("string")).alias("text")), run, RESULT)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, columns unchanged, whose text is in one of the model's languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = len(docs.columns)

    def run(batches):
        m = shared.value
        for b in batches:
            off, raw = text_buffers(b.column(at))
            keep = [m.classify(off[i: j + 1] - off[i], raw[off[i]: off[j]])[3] for i, j in slices(off, SLICE_BYTES)]
            yield b.select(range(at)).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return map_rows(docs, run, F.lower(docs["text"].cast("string")))
