"""Registered queries: name -> (spark, sf_dir) callable, and the equivalent DuckDB SQL."""
from __future__ import annotations

from skein.plans import further, graphs, hygiene, reading, text, topics, vectors, written
from skein.plans.registry import ORACLES, QUERIES

__all__ = ["further", "graphs", "hygiene", "reading", "text", "topics", "vectors", "written"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
