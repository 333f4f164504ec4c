"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each query is a function (spark, sf_dir) -> DataFrame over the whole input
tables.  Its oracle (if any) is ANSI SQL that DuckDB runs on the same parquet
tables, prefixed with the logical views it needs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.oracle_views import with_views
from lectern.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register `fn` under `name`; `sql` (with `views`) is its oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)  # UTC session time zone, AQE; cluster-set values win
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco


def load_all() -> None:
    from lectern.plans import (listing, activity, monitoring, textual, recs,  # noqa: F401
                               ingest, pages, streams, coverage)
