"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views as the query of that name, with the SQL (over tables and {views}) that gives the same rows."""

    def made(f: Callable[[views.Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(views.Views(spark, sf_dir))
        if sql:
            ORACLES[name] = views.sql(sql)
        return f

    return made
