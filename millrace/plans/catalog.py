"""All queries of the engine's own operators."""

from __future__ import annotations

from millrace.plans import files, loading, mixtures, queries, scoring  # noqa: F401
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
