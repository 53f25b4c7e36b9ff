"""All registered queries of the reference's operators, with the SQL that checks them."""

from __future__ import annotations

from rockframe.plans import function_queries, further_queries, grid_queries, join_queries, kernel_queries, porosity_queries, table_queries  # noqa: F401
from rockframe.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
