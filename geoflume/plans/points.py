"""The point view of the driver's tables: stations, times and derived places.

The tables have no places, so they are derived from keys by integer arithmetic
that any engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.functions.grid import Grid
from geoflume.functions.projection import Lambert

#: Continental US at one degree, and a Lambert grid of 108 km over it.
ONE_DEGREE = Grid(60, 25, -125.0, 25.0, 1.0, 1.0)
LAMBERT = Grid(54, 38, -2916000.0, -2052000.0, 108000.0, 108000.0, Lambert(6370000.0, 6370000.0, -97.0, 40.0, 33.0, 45.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, station, variable, value, lon, lat."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("station"),
        F.col("event_type").alias("variable"),
        "value",
        ((F.col("user_id") * 37 % 6000) / 100.0 - 125.0).alias("lon"),
        ((F.col("user_id") * 53 % 2500) / 100.0 + 25.0).alias("lat"),
    )


#: The same in SQL.
POINTS_SQL = """points AS (
  SELECT event_id, ts, user_id AS station, event_type AS variable, value,
    (user_id * 37 % 6000)::DOUBLE / 100.0::DOUBLE - 125.0::DOUBLE AS lon,
    (user_id * 53 % 2500)::DOUBLE / 100.0::DOUBLE + 25.0::DOUBLE AS lat
  FROM events
)"""
