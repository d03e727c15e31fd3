"""Operator registry: name -> query over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is its oracle, none where SQL cannot express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _ORACLES[key] = sql
        return f

    return register


def _load() -> None:
    from tessel import plans

    plans.load()


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
