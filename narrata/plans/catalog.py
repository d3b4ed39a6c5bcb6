"""Registry of named queries and their SQL oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Every query reads the driver tables (or views derived from them by Spark),
so its work grows with the data; none runs on made-up input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from narrata.plans import queries_core  # noqa: F401
    from narrata.plans import queries_profile  # noqa: F401
    from narrata.plans import queries_eval  # noqa: F401
    from narrata.plans import queries_io  # noqa: F401
    from narrata.plans import queries_features  # noqa: F401
    from narrata.plans import queries_models  # noqa: F401
