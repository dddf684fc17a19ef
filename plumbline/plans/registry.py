"""Registry of named queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.columns import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; doubles are rounded on the Spark side as the SQL rounds them."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__name__, run.__doc__ = key, fn.__doc__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
