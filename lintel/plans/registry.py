"""Queries by name, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.plans.views import VIEWS, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; views that the SQL names are put before it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            names = [] if sql.startswith("with v_") else needed(sql)  # the SQL of another query has its views already
            own = sql.strip().removeprefix("with ") if names and sql.startswith("with ") else None
            ORACLES[f.__name__] = (f"with {', '.join(f'{n} as ({VIEWS[n]})' for n in names)}{', ' + own if own else ' ' + sql.strip()}") if names else sql.strip()
        return f

    return register
