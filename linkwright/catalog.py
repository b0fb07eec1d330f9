"""All driver queries of the linkage engine."""

from __future__ import annotations

from . import catalog_linkage, catalog_methods, catalog_results, catalog_telemetry, catalog_text  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
