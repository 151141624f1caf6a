"""Registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from schedlake.bindings import Views
from schedlake.oracle_views import with_views
from schedlake.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(views)``; ``sql`` is the DuckDB check over the named views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_views(views, sql)
        return fn

    return wrap
