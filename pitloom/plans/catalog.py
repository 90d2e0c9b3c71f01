"""Importing this module registers every query of the catalog."""

from __future__ import annotations

from pitloom.plans import (  # noqa: F401
    event_queries,
    join_queries,
    metric_queries,
    model_queries,
    publication_queries,
    quality_queries,
)
from pitloom.plans import lifecycle  # noqa: F401,E402
from pitloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
