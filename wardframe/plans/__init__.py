"""Queries over the supplied tables, and the same results in plain SQL."""

from wardframe.plans import files, note_queries, scoring, series, structured  # noqa: F401
from wardframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
