"""Registered queries: every operator on the given tables, with its SQL where one exists."""

from rulespire.catalog.base import ORACLES, QUERIES
from rulespire.catalog import (  # noqa: F401  (importing registers)
    analytics, ensembles, explaining, profiling, scoring, searching, splits, trees,
)

__all__ = ["QUERIES", "ORACLES"]
