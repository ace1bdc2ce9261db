"""Importing this module registers every query."""

from sigvane.plans import queries_entities, queries_panel, queries_regression, queries_signals, queries_tables, queries_text  # noqa: F401
from sigvane.plans.registry import QUERIES

__all__ = ["QUERIES"]
