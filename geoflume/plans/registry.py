"""The queries over the driver's tables by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoflume.plans.points import POINTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, folder of tables) and the SQL of its rows, in which ``points`` may be used."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = f"WITH {POINTS_SQL}\n{sql}" if "points" in sql and not sql.lstrip().startswith("WITH") else sql
        return f

    return add
