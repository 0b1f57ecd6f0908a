"""Register of queries: name -> (Spark plan, optional DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopflow.plans.adapter import Tables, with_tables

_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "stops"):
    """Decorator: register a function Tables -> DataFrame under `name`."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"query {name} registered twice")
        _PLANS[name] = fn
        if sql is not None:
            _SQL[name] = with_tables(sql, *needs.split()) if needs else sql.strip()
        return fn

    return add


def _load() -> None:
    from stopflow.plans import catalog  # noqa: F401  (registers on import)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
