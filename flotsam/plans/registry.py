"""Name → (Spark query, DuckDB oracle) registry used by ``__spark_entry__``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flotsam import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, *views: str, oracle: str | None = None):
    """Register ``fn(fx)``; ``fx`` gives the fixture views as DataFrames.

    ``views`` are the fixture views the oracle text reads; they become CTEs in front of it.
    """
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixtures.Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = fixtures.with_views(views, oracle)
        return fn
    return wrap
