"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .datasets import Dataset
from .views import with_views

_QUERIES: dict[str, Callable[[Dataset], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; *views* names the shared SQL views its twin reads."""

    def keep(fn: Callable[[Dataset], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_views(views.split(), sql)
        return fn

    return keep


def _load() -> None:
    from . import (  # noqa: F401
        q_judgments, q_ledger, q_portfolio, q_reads, q_signals, q_study, q_text,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Dataset(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
