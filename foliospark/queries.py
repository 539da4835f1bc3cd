"""Registered queries of the document-analytics operators and their DuckDB SQL."""

from __future__ import annotations

from foliospark.qs import export, intake, intervals, reasoning, relational, workers  # noqa: F401  (each fills the registry)
from foliospark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
