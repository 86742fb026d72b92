"""Every query of the library by name, with its DuckDB twin."""

from __future__ import annotations

from credence.plans import evidence, fitting, graph, ingest, learning, reports, scoring, series, splits  # noqa: F401  they register
from credence.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
