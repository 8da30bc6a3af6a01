"""Registered queries with the SQL each is checked against."""

from catalog import aggregates, breakdowns, columns, display, filters, formulas, joins, reports, shaping, sources  # noqa: F401
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
