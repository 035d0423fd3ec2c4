"""Registry of named queries: a Spark implementation and (where SQL can express it) a DuckDB twin.

Each query reads whole given tables (or frames Spark derives from them).  Doubles are rounded
to 6 digits in both engines and every column is aliased the same way in both.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` may be a function, called only when the SQL is asked for."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if callable(sql) else sql.strip()
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    """The SQL twins; one that cannot be written here is left out with a warning, the rest stay."""
    out = {}
    for name, sql in ORACLES.items():
        try:
            out[name] = sql().strip() if callable(sql) else sql
        except (OSError, RuntimeError) as e:
            warnings.warn(f"no SQL twin for {name}: {e}", stacklevel=2)
    return out


def load_all() -> None:
    """Import the modules that register queries."""
    from loupe.plans import queries_tables, queries_model, queries_more, queries_learners  # noqa: F401
