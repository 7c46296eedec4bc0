"""Every registered query with its DuckDB twin."""

from __future__ import annotations

from quillmesh.plans import decision_queries, filter_queries, mining_queries, review_queries, rule_queries, stat_queries, text_queries  # noqa: F401  each module registers its queries
from quillmesh.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
