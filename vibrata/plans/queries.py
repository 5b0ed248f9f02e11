"""All registered queries of this library."""

from __future__ import annotations

from vibrata.plans import queries_long, queries_models, queries_windows  # noqa: F401  they register themselves
from vibrata.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
