"""Registered queries and the SQL that checks them."""

from tidemark.catalog import aggregates, alerts, forecasts, selection, tables, windows  # noqa: F401
from tidemark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
