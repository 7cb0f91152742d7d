"""The registered queries: each with, where SQL can say it, the DuckDB text that must give the same rows."""

from __future__ import annotations

import importlib

PARTS = ("relational", "triples", "lexical", "vector", "graph", "text", "lifecycle", "context", "search", "metrics", "io", "streams")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in PARTS:
    try:
        _module = importlib.import_module(f"skein.queries.{_part}")
    except ModuleNotFoundError as e:
        if e.name != f"skein.queries.{_part}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
