"""Registry of named queries: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenure.sources.views import ORACLE_VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_views(ctes: str, select: str) -> str:
    """Oracle SQL: the stand-in views as CTEs, then ``ctes`` (may be empty), then the query."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {ORACLE_VIEWS.strip()}{extra}\n{select.strip()}"


MODULES = ("q_activity", "q_sampling", "q_segments", "q_profile", "q_stats", "q_metrics", "q_models", "q_streaming")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"tenure.plans.{m}")
