"""Registered queries; importing the panels adds theirs to the registry."""

from tallyloom.plans import browser, panels, recipes, scalars, structure  # noqa: F401
from tallyloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
