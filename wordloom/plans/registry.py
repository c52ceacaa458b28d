"""Query registry: name → (Spark callable, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import session_key

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement (None = rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


_LEXICONS: dict = {}


def builtin_lexicon(spark: SparkSession):
    """The parsed built-in lexicon, parsed once per session."""
    from ..operators.lexicon import Lexicon

    key = session_key(spark)
    if key not in _LEXICONS:
        _LEXICONS[key] = Lexicon.builtin(spark)
    return _LEXICONS[key]
