"""The registry of queries: a name, a function of ``Tables``, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskweave.plans.adapters import Tables
from riskweave.plans.views import sql as with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(tables)`` under ``name``; ``sql`` may use the views by name."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(function, None if sql is None else with_views(sql))
        return function

    return register


def load() -> dict[str, Query]:
    from riskweave.plans import (  # noqa: F401
        q_dashboard,
        q_detection,
        q_evaluation,
        q_fixes,
        q_knowledge,
        q_lifecycle,
        q_scalars,
        q_sources,
    )

    return QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Query):
        return lambda spark, folder: entry.build(Tables(spark, folder))

    return {name: bind(entry) for name, entry in load().items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in load().items() if entry.sql is not None}
