"""The query catalogue of the library's own operators: name -> Spark query, and name -> DuckDB oracle."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _part in ("documents", "evidence", "cases", "records", "pages", "context", "retrieval"):
    importlib.import_module(f"{__package__}.{_part}")

__all__ = ["ORACLES", "QUERIES"]
