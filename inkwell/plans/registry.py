"""Registry of the engine's queries: name, DataFrame builder, and the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is None where SQL can't express it."""

    def register(builder: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = builder
        if sql is not None:
            _SQL[name] = sql
        return builder

    return register


def oracle_of(builder: Query) -> str:
    """The SQL of a registered query, for another way to the same rows."""
    return next(_SQL[name] for name, known in _QUERIES.items() if known is builder)


def _load() -> None:
    from inkwell.plans import change_queries, detail_queries, feature_queries, index_queries, relational_queries, retrieval_queries, store_queries, streaming_queries, text_queries, upkeep_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
