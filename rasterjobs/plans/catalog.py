"""All registered queries."""

from __future__ import annotations

from rasterjobs.plans import file_queries, model_queries, queries  # noqa: F401  (each registers its own)
from rasterjobs.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
