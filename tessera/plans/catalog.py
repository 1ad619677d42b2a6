"""The registry of named queries: each is a callable (spark, sf_dir) -> DataFrame and,
where the semantics are SQL-expressible, a DuckDB-runnable SQL twin over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` (with its SQL twin, if any)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return wrap


def _load_all() -> None:
    # importing the modules registers their queries
    from tessera.plans import (  # noqa: F401
        q_audit, q_closed, q_folds, q_logs, q_prepare, q_profile, q_registry, q_runs, q_score,
        q_sources, q_train,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
