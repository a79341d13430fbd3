"""Every query of the core engine by name, with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from bidloom.plans import data_queries, engine_queries, flag_queries, more_queries
from bidloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data_queries", "engine_queries", "flag_queries", "more_queries"]
