"""Functions that need Python: Arrow batches, never one row at a time."""
from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a, b):
    """Ratcliff-Obershelp similarity of two text columns; only for candidate pairs."""
    return F.pandas_udf(_ratios, "double")(a, b)


def balanced(text: str) -> str | None:
    """The first balanced JSON object or array in a text."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    stack, quoted, skip = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start: i + 1]
    return None


def repair(text: str | None) -> str | None:
    """Strict JSON out of a model's answer: fences, preamble, smart quotes, trailing commas."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = (fence[1] if fence else text).translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})
    found = balanced(body)
    if found is None:
        return None
    try:
        return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", found)), ensure_ascii=False)
    except ValueError:
        return None


def _repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)


def repair_json(text):
    """A column of model answers as strict JSON; null where there is none."""
    return F.pandas_udf(_repaired, "string")(text)


def chunk_text(text: str, max_chars: int = 1800, overlap: int = 200, max_chunks: int = 20) -> list[str]:
    """Windows that end at the last white space of their final 120 characters where there is one."""
    out, start, n = [], 0, len(text)
    if not text:
        return out
    while start < n and len(out) < max_chunks:
        end = min(n, start + max_chars)
        if end < n:
            floor = max(start + 1, end - 120)
            at = next((i for i in range(end - 1, floor - 1, -1) if text[i].isspace()), None)
            end = end if at is None else at
        out.append(text[start:end])
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def chunks(max_chars: int = 1800, overlap: int = 200, max_chunks: int = 20):
    """A function of a text column that gives its chunks, in order."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunk_text(t or "", max_chars, overlap, max_chunks))

    return F.pandas_udf(run, "array<string>")
