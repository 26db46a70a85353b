"""Registered queries: name → (Spark callable, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name`` with the SQL it must agree with."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(expr: str, places: int) -> str:
    """The SQL twin of ``functions.rates.fixed``."""
    scale = f"{10**places}.0"
    return f"(floor(({expr})*cast({scale} as double)+cast(0.5 as double))/cast({scale} as double))"
