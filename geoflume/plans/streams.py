"""Queries through files of records, cursors and state: the tables are written in a format or replayed as a stream, and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from geoflume.functions import timecodes as T
from geoflume.operators import exact as E
from geoflume.operators.archive import switched
from geoflume.plans.formats import folder
from geoflume.plans.points import points, table
from geoflume.plans.registry import query
from geoflume.sources import record_files as R
from geoflume.sources import sensor_cursor as C
from geoflume.streaming import detect as D

_HISTORY, _ORDER = 48, 2


@query(f"""WITH r AS (SELECT user_id AS sensor, ts, value FROM events WHERE value IS NOT NULL),
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER o > INTERVAL 2 DAY THEN 1 ELSE 0 END AS gap FROM r WINDOW o AS (PARTITION BY sensor ORDER BY ts, value)),
runs AS (SELECT *, sum(gap) OVER (PARTITION BY sensor ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
past AS (SELECT *, coalesce(list(value) OVER (PARTITION BY sensor, run ORDER BY ts, value ROWS BETWEEN {_HISTORY} PRECEDING AND 1 PRECEDING), []) AS l FROM runs),
lags AS (
  SELECT *, len(l) AS n, list_avg(l) AS m, list_transform(l, lambda x: x - list_avg(l)) AS c FROM past
),
auto AS (
  SELECT *, list_dot_product(c, c) AS r0, list_dot_product(c[1 : n - 1], c[2 : n]) AS r1, list_dot_product(c[1 : n - 2], c[3 : n]) AS r2 FROM lags WHERE n >= {2 * _ORDER + 2}
),
k1 AS (SELECT *, CASE WHEN r0 > 0 THEN r1 / r0 ELSE 0 END AS a1 FROM auto),
k2 AS (SELECT *, r0 * (1 - a1 * a1) AS e1, CASE WHEN r0 > 0 THEN (r2 - a1 * r1) / (r0 * (1 - a1 * a1)) ELSE 0 END AS a2 FROM k1),
guess AS (SELECT sensor, ts, value, run, m + (a1 - a2 * a1) * c[n] + a2 * c[n - 1] AS prediction, sqrt(greatest(e1 * (1 - a2 * a2), 0) / n) AS spread FROM k2),
seen AS (
  SELECT p.sensor, p.ts, p.value, p.run, g.prediction, coalesce(abs(p.value - g.prediction) > 0.9 * greatest(g.spread, 1e-9), false) AS outlier
  FROM past p LEFT JOIN guess g ON p.sensor = g.sensor AND p.ts = g.ts AND p.value = g.value AND p.run = g.run
),
counted AS (
  SELECT *, count(*) OVER w AS have, count(*) FILTER (outlier) OVER w AS k FROM seen WINDOW w AS (PARTITION BY sensor, run ORDER BY ts, value ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
),
chance AS (SELECT *, CASE WHEN have = 8 THEN [1, 9, 37, 93, 163, 219, 247, 255, 256][k + 1] / 256.0::DOUBLE END AS probability FROM counted),
hot AS (SELECT *, coalesce(probability >= 0.85, false) AS on_, sum(CASE WHEN coalesce(probability >= 0.85, false) THEN 0 ELSE 1 END) OVER (PARTITION BY sensor, run ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS island FROM chance),
long AS (SELECT *, count(*) FILTER (on_) OVER (PARTITION BY sensor, run, island ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS steps FROM hot)
SELECT sensor, epoch_us(ts) AS at, value, round(prediction, 6) AS prediction, outlier, probability, on_ AND steps <= 15 AS event, on_ AND steps > 15 AS baseline FROM long""")
def water_events(spark, d):
    """Events by linear prediction, replayed as a stream; order 2, whose recursion can be written out in SQL."""
    at = folder(D.stateful(spark))
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    found = D.events(stream.select(F.col("user_id").alias("sensor"), "ts", "value"), history=_HISTORY, order=_ORDER)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.select("sensor", F.unix_micros("ts").alias("at"), "value", F.round("prediction", 6).alias("prediction"), "outlier", "probability", "event", "baseline")


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS stamp, lon, lat, value, variable AS note, ts >= TIMESTAMP '2024-01-15' AS later FROM points WHERE value IS NOT NULL")
def point_file_rows(spark, d):
    """Point streams written with a commit, read in splits, either half sought by time."""
    at = folder(R.register(spark))
    rows = points(spark, d).filter("value is not null")
    rows = rows.select(F.col("variable").alias("note"), T.pack(F.col("ts"), "yyyyMMddHHmmss").alias("stamp"), "lon", "lat", F.lit(0.0).alias("elevation"), F.col("event_id").alias("id"), "value")
    R.write_points(rows, at, "pm25", "ug/m3", "2024-01-01T00:00:00-0000")
    edge, split = 20240115000000, 1 << 20
    both = R.read_points(spark, at, high=edge, splitbytes=split).withColumn("later", F.lit(False)).unionByName(R.read_points(spark, at, low=edge, splitbytes=split).withColumn("later", F.lit(True)))
    return both.select(F.col("id").cast("long").alias("event_id"), F.col("stamp").cast("long").alias("stamp"), "lon", "lat", "value", "note", "later")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value, ts >= TIMESTAMP '2024-01-15' AS later FROM points WHERE value IS NOT NULL")
def day_file_rows(spark, d):
    """Equally long lines in order of their day, under a header in each file; either half sought by day."""
    at = f"{folder(spark)}/days"
    rows = points(spark, d).filter("value is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("%012d", "event_id").alias("event_id"), F.format_string("%+020.10f", "value").alias("value"))
    E.write_ordered(rows, at, [F.col("day"), F.col("event_id")])
    edge, split = "2024-01-15", 1 << 18
    both = R.read_days(spark, at, high=edge, splitbytes=split).withColumn("later", F.lit(False)).unionByName(R.read_days(spark, at, low=edge, splitbytes=split).withColumn("later", F.lit(True)))
    return both.select(F.col("event_id").cast("long").alias("event_id"), "day", F.col("value").cast("double").alias("value"), "later")


@query("""SELECT strftime(ts, '%Y%m%d%H')::BIGINT AS hour, floor(lat - 25)::INTEGER AS row, floor(lon + 125)::INTEGER AS col, count(*)::DOUBLE AS value FROM points GROUP BY ALL""")
def grid_file_cells(spark, d):
    """Readings an hour and cell as one grid file an hour, read back."""
    at = folder(R.register(spark))
    cell = [F.floor(F.col("lat") - 25).cast("int").alias("row"), F.floor(F.col("lon") + 125).cast("int").alias("col")]
    cells = points(spark, d).groupBy(T.pack(F.col("ts")).alias("hour"), *cell).agg(F.count("*").cast("double").alias("value"))
    R.write_grids(cells, at, 25, 60)
    return spark.read.format("grid_f32").options(rows=25, cols=60).load(at)


@query("SELECT strftime(ts, '%Y%m%d%H')::BIGINT AS hour, event_id, variable, value FROM points")
def cursor_rows(spark, d):
    """Snapshots of an hour each, read by the stream whose cursor is their stamp."""
    at = folder(R.register(spark))
    fields = ["id", "variable", "value"]
    of = points(spark, d).groupBy(F.date_format("ts", "yyyyMMddHH").alias("hour")).agg(F.collect_list(F.array(F.col("event_id").cast("string"), "variable", F.col("value").cast("string"))).alias("data"))
    text = F.to_json(F.struct(F.lit(0).alias("data_time_stamp"), F.array(*map(F.lit, fields)).alias("fields"), "data"), {"ignoreNullFields": "false"})
    of.select(F.concat(F.lit("station_"), "hour", F.lit("0000.json")).alias("name"), text.cast("binary").alias("content")).write.format("named_files").mode("append").save(f"{at}/in")
    C.snapshots(spark, f"{at}/in").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("stamp string, reading map<string,string>").parquet(f"{at}/out")
    get = lambda k: F.col("reading")[k]
    return rows.select(F.substring("stamp", 1, 10).cast("long").alias("hour"), get("id").cast("long").alias("event_id"), get("variable").alias("variable"), get("value").cast("double").alias("value"))


@query("""SELECT today, event_id, value, CASE WHEN ts < edge AND (ts < TIMESTAMP '2024-01-11' OR (ts < TIMESTAMP '2024-01-16' AND event_id % 10 <> 0)) THEN 'archive' ELSE 'live' END AS origin
FROM (SELECT *, (today::TIMESTAMP - INTERVAL 12 DAY) AS edge FROM points, (VALUES (DATE '2024-01-25'), (DATE '2024-01-28')) t(today))""")
def archive_switch(spark, d):
    """One relation on two days: the archive has all up to the 11th and, lagging, nine tenths up to the 16th; live rows begin on the 11th."""
    rows = points(spark, d)
    archive = rows.filter("ts < timestamp'2024-01-11' or ts < timestamp'2024-01-16' and event_id % 10 <> 0")
    live = rows.filter("ts >= timestamp'2024-01-11'")
    served = None
    for today in (dt.date(2024, 1, 25), dt.date(2024, 1, 28)):
        one = switched(archive, live, ["event_id"], "ts", today, 12).withColumn("today", F.lit(today))
        served = one if served is None else served.unionByName(one)
    return served.select("today", "event_id", "value", "origin")
