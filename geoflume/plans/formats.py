"""Queries through the readers, sinks and streams: the tables are written in a format and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from geoflume.functions import timecodes as T
from geoflume.plans.points import points, table
from geoflume.plans.registry import query
from geoflume.sources import binary as B
from geoflume.sources import tables as S
from geoflume.sources import text_sinks as K
from geoflume.streaming import rollups as R


def folder(spark) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset, a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or None
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='geoflume-')}/formats-{uuid.uuid4().hex}"


@query("SELECT event_id, strftime(ts, '%Y%m%d%H')::BIGINT AS hour, lon, value FROM points WHERE event_id % 9 <> 4")
def csv_sensor_rows(spark, d):
    at = folder(spark)
    time = F.when(F.col("event_id") % 9 != 4, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise("never")
    points(spark, d).select("event_id", time.alias("when"), "lon", "value", F.lit(1).alias("hru7")).write.csv(at, header=True)
    rows = S.sensor_csv(spark, at, "when", True)
    return rows.select(F.col("event_id").cast("long").alias("event_id"), T.pack(F.col("ts")).alias("hour"), F.col("lon").cast("double").alias("lon"), F.col("value").cast("double").alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN station END AS station, variable FROM points")
def fixed_width_rows(spark, d):
    at = folder(spark)
    station = F.when(F.col("event_id") % 7 == 3, "?").otherwise(F.col("station").cast("string"))
    line = F.concat(F.lpad(F.col("event_id").cast("string"), 12, " "), F.lpad(station, 9, " "), F.lit(" "), F.rpad("variable", 12, " "))
    heads = spark.range(3).select(F.lit("# station readings").alias("line"))
    points(spark, d).select(line.alias("line")).unionByName(heads).write.text(at)
    return S.fixed_width(spark, at, [("event_id", 1, 12, "long"), ("station", 13, 9, "long"), ("variable", 23, 12, "string")], "^#")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'P' ELSE 'A' END AS quality, value FROM points WHERE value IS NOT NULL")
def xml_series_rows(spark, d):
    at = folder(spark)
    rows = points(spark, d).filter("value is not null")
    rows = rows.select(F.col("event_id").alias("_id"), F.when(F.col("event_id") % 5 == 0, "P").otherwise("A").alias("_quality"), F.col("value").alias("reading"))
    rows.write.format("xml").option("rowTag", "value").option("valueTag", "reading").save(at)
    return S.water_xml(spark, at).select(F.col("_id").cast("long").alias("event_id"), F.col("_quality").alias("quality"), F.col("reading").cast("double").alias("value"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS stamp, lon, lat, value, variable AS note FROM points WHERE value IS NOT NULL")
def point_stream_rows(spark, d):
    rows = points(spark, d).filter("value is not null")
    rows = rows.select(F.col("variable").alias("note"), T.pack(F.col("ts"), "yyyyMMddHHmmss").alias("stamp"), "lon", "lat", F.lit(0.0).alias("elevation"), F.col("event_id").alias("id"), "value")
    streams = B.point_streams(rows, "pm25", "ug/m3", "2024-01-01T00:00:00-0000")
    back = B.points_of(streams.select(F.col("part").cast("string").alias("path"), "content"))
    return back.select(F.col("id").cast("long").alias("event_id"), F.col("stamp").cast("long").alias("stamp"), "lon", "lat", "value", "note")


@query("SELECT event_id, lon, value FROM points")
def sheet_rows(spark, d):
    at = folder(spark)
    K.write_sheet(points(spark, d).select("event_id", "lon", "value"), at, {"lon": "deg", "value": "ppb"}, compress=True)
    rows = spark.read.csv(at, sep="\t", header=True, schema="`event_id(-)` long, `lon(deg)` double, `value(ppb)` double", enforceSchema=False)
    return rows.toDF("event_id", "lon", "value")


@query("SELECT event_id, strftime(ts, '%Y%m%d')::BIGINT AS day FROM points")
def month_name_dates(spark, d):
    text = F.upper(F.date_format("ts", "MMM-dd-yyyy"))
    return points(spark, d).select("event_id", T.pack(S.month_name_date(text), "yyyyMMdd").alias("day"))


@query("""SELECT station AS sensor, strftime(ts, '%Y%m%d')::BIGINT AS day, round(avg(value), 6) AS value, count(value) AS n FROM points
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM points) GROUP BY ALL""")
def closed_daily_means(spark, d):
    at = folder(spark)
    # a pattern, as a stream takes a plain path for a folder
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    readings = stream.select(F.col("user_id").alias("sensor"), "ts", "value")
    R.upsert(R.closed_means(readings, "1 day", "1 hour"), f"{at}/out", f"{at}/state", ["sensor", "start"]).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("sensor", T.pack(F.col("start"), "yyyyMMdd").alias("day"), F.round("value", 6).alias("value"), "n")
