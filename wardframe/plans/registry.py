"""Named queries with, where SQL can express them, the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardframe.plans.inputs import sql_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def with_views(*views: str, **ctes: str) -> str:
    """``WITH`` clause of input views followed by further common table expressions."""
    parts = [f"{v} AS ({sql_view(v)})" for v in views]
    parts += [f"{n} AS ({body})" for n, body in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def listed(values) -> str:
    """Python values as a SQL list."""
    return ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
