"""Queries of monitoring files: the tables are written in their formats and read back by their column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflume.functions.projection import NAMED_ELLIPSOIDS, Lambert, ellipsoid
from geoflume.plans.formats import folder
from geoflume.plans.points import points, table
from geoflume.plans.registry import query
from geoflume.sources import monitoring as M
from geoflume.sources import record_files as R
from geoflume.sources import text_sinks as K


def _line(cells: dict[int, object], n: int):
    return F.concat_ws(",", *[F.coalesce(cells[k].cast("string"), F.lit("")) if k in cells else F.lit("") for k in range(n)])


def _wide(spark, d, at):
    e, p = F.col("event_id"), points(spark, d)
    site = F.concat(F.lit("NCA"), F.lpad(F.col("station").cast("string"), 5, "0"))
    layer = F.concat(site, F.lit("_1_"), F.element_at(F.array(*map(F.lit, ("SURFACE", "MID-WATER", "BOTTOM"))), (e % 3 + 1).cast("int")))
    value = F.when(e % 10 == 0, F.lit(-9.0)).otherwise(F.col("value"))
    cells = {0: site, 2: e, 6: layer, 7: F.year("ts"), 8: F.date_format("ts", "M/d/yyyy"), 9: F.dayofyear("ts"), 10: F.col("lat"), 11: F.col("lon"), 13: F.when(e % 11 != 5, F.lit("Gulf")), 15: e % 20, 22: value, 35: F.concat(F.lit("q"), e % 4)}
    p.select(_line(cells, 44).alias("line")).unionByName(spark.range(1).select(F.lit("SITE_ID" + ",x" * 43).alias("line"))).write.text(at)


_WIDE_SQL = "SELECT *, 'NCA' || lpad(station::VARCHAR, 5, '0') AS site, ['SURFACE', 'MID-WATER', 'BOTTOM'][event_id % 3 + 1] AS layer FROM points WHERE event_id % 11 <> 5"


@query(f"""SELECT event_id, ('1431' || lpad(station::VARCHAR, 5, '0'))::BIGINT AS station, strftime(ts, '%Y%m%d')::BIGINT AS day, lon, lat,
CASE event_id % 3 WHEN 0 THEN -0.1 WHEN 1 THEN -0.5 * (event_id % 20) ELSE 0.0 - (event_id % 20) END::DOUBLE AS depth, value, site || ' ' || site || '_1_' || layer || ' Gulf Pub:' || event_id || ' q' || event_id % 4 AS note
FROM ({_WIDE_SQL}) WHERE value IS NOT NULL AND event_id % 10 <> 0""")
def survey_wide_rows(spark, d):
    at = folder(spark)
    _wide(spark, d, at)
    rows = M.survey_wide(spark, at, "chlorophyll_a")
    event = F.regexp_extract("note", r"Pub:(\d+)", 1).cast("long")
    return rows.select(event.alias("event_id"), F.col("station").cast("long").alias("station"), F.date_format("day", "yyyyMMdd").cast("long").alias("day"), "lon", "lat", (F.col("depth") + 0.0).alias("depth"), "value", "note")


@query(f"SELECT site, min(strftime(ts, '%Y%m%d')::BIGINT) AS day FROM ({_WIDE_SQL}) GROUP BY 1")
def survey_site_list(spark, d):
    at = folder(spark)
    _wide(spark, d, at)
    return M.survey_sites(spark, at).select("site", F.date_format("day", "yyyyMMdd").cast("long").alias("day"))


@query("""SELECT event_id, station, strftime(ts, '%Y%m%d')::BIGINT AS day, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE 0.0 - event_id % 9 END::DOUBLE AS depth, value,
'E' || event_id || ';' || station || ';ESTCODE:X;lrl:0.1;mdl:0.05;flag:' || CASE WHEN event_id % 4 = 0 THEN 'ND' ELSE 'ok' END || ';method:m' AS note
FROM points WHERE value IS NOT NULL AND event_id % 6 = 1""")
def survey_long_rows(spark, d):
    at, e = folder(spark), F.col("event_id")
    text = lambda x: F.lit(x)
    analyte = F.element_at(F.array(*map(F.lit, ("COND", "CHLA", "DIN"))), (e % 3 + 1).cast("int"))
    result = F.when(e % 6 == 4, F.lit(-1.0)).otherwise(F.col("value"))
    cells = {0: F.concat(text("E"), e), 1: F.date_format("ts", "yyyy-MM-dd"), 2: text("1"), 3: F.col("station"), 4: text("X"), 5: F.col("lon"), 6: F.col("lat"), 7: e % 9, 8: analyte, 9: result, 10: text("u"), 11: text("0.1"), 12: text("0.05"), 13: text("m"), 14: F.when(e % 4 == 0, "ND").otherwise("ok")}
    points(spark, d).select(_line(cells, 15).alias("line")).write.text(at)
    rows = M.survey_long(spark, at, "chlorophyll_a")
    return rows.select(F.regexp_extract("site", r"(\d+)", 1).cast("long").alias("event_id"), "station", F.date_format("day", "yyyyMMdd").cast("long").alias("day"), F.when(F.col("depth") == 0, 0.0).otherwise(F.col("depth")).alias("depth"), "value", "note")


@query('SELECT event_id, lon AS "Lon", lat AS "Lat", CASE WHEN event_id % 7 <> 0 THEN value END AS "NO2(ppb)", (event_id % 100)::DOUBLE AS "MLH(m)" FROM points')
def flight_rows(spark, d):
    at, e = folder(spark), F.col("event_id")
    mixing = F.when(e % 7 == 0, F.lit(-9999)).otherwise(F.col("value"))
    points(spark, d).select(e.alias("event_id"), F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), mixing.alias("HSRL Mixing Ratio (ppb)"), (e % 100).alias("ML(m)")).write.csv(at, header=True)
    return M.flights(spark, at).withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT station, variable AS name, strftime(ts + INTERVAL 5 HOUR, '%Y%m%d%H%M%S')::BIGINT AS stamp, value FROM points WHERE value IS NOT NULL")
def zoned_series_rows(spark, d):
    at = folder(R.register(spark))
    of = points(spark, d).groupBy("station", "variable").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "value")).alias("data"))
    docs = of.groupBy(F.col("station").cast("string").alias("device")).agg(F.collect_list(F.struct(F.col("variable").alias("name"), F.lit("u").alias("unit"), "data")).alias("parameters"))
    text = F.to_json(F.struct("device", "parameters")).cast("binary")
    docs.select(F.concat(F.lit("d"), "device", F.lit(".json")).alias("name"), text.alias("content")).write.format("named_files").mode("append").save(at)
    rows = M.zoned_series(spark, at, "Eastern")
    return rows.select(F.col("device").cast("long").alias("station"), "name", F.date_format("ts", "yyyyMMddHHmmss").cast("long").alias("stamp"), "value")


@query("SELECT station AS site, lon, lat, variable AS unit, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS stamp, value FROM points WHERE value IS NOT NULL AND station % 5 <> 2")
def water_site_series(spark, d):
    at = folder(spark)
    of = points(spark, d).filter("value is not null").groupBy("station", "lon", "lat", "variable").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("_dateTime"), F.col("value").alias("_VALUE"))).alias("v"))
    place = F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geogLocation"))
    site = F.when(F.col("station") % 5 != 2, F.col("station").cast("string"))  # the others lack one
    of.select(F.struct(site.alias("siteCode"), place.alias("geoLocation")).alias("sourceInfo"), F.struct(F.struct(F.col("variable").alias("unitCode")).alias("unit")).alias("variable"), F.struct(F.col("v").alias("value")).alias("values")).write.format("xml").option("rowTag", "timeSeries").save(at)
    rows = M.water_series(spark, at)
    return rows.select(F.col("site").cast("long").alias("site"), "lon", "lat", "unit", F.date_format("ts", "yyyyMMddHHmmss").cast("long").alias("stamp"), "value")


@query("SELECT event_id, value FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def masked_csv(spark, d):
    """A CSV cut to the ids that a mask has kept, written and read back."""
    at = folder(spark)
    rows = table(spark, d, "events").select("event_id", F.format_string(" %d ", "user_id").alias("estuary"), "value")
    rows.write.csv(f"{at}/all", header=True)
    kept = M.masked(spark.read.csv(f"{at}/all", header=True), table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("estuary")), "estuary")
    kept.write.csv(f"{at}/kept", header=True)
    return spark.read.csv(f"{at}/kept", header=True).select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


@query("""SELECT s_suppkey, '<Placemark><name>s' || s_suppkey || '</name><description>' || s_suppkey % 3 || '</description><Polygon><outerBoundaryIs><LinearRing><coordinates>'
|| printf('%.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f', x, 1.0::DOUBLE, x + 2, 1.0::DOUBLE, x + 2, 4.0::DOUBLE, x, 1.0::DOUBLE) || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS line
FROM (SELECT s_suppkey, (s_suppkey % 90)::DOUBLE AS x FROM supplier)""")
def kml_polygon_lines(spark, d):
    x = (F.col("s_suppkey") % 90).cast("double")
    ring = F.struct(F.array(x, x + 2, x + 2).alias("xs"), F.array(F.lit(1.0), F.lit(1.0), F.lit(4.0)).alias("ys"))
    at = folder(spark)
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 3).alias("v"), F.array(ring).alias("rings"))
    K.kml_polygons(rows, "name", "v").write.text(at)
    return spark.read.text(at).select(F.regexp_extract("value", r"<name>s(\d+)", 1).cast("long").alias("s_suppkey"), F.col("value").alias("line"))


_NAMES = sorted(NAMED_ELLIPSOIDS)


@query("SELECT event_id, round(lon, 5) AS lon, round(lat, 5) AS lat FROM points")
def ellipsoid_roundtrips(spark, d):
    """There and back on every named ellipsoid, each reading on one of them by its id."""
    p, n = points(spark, d), len(_NAMES)
    lon = lat = None
    for k, name in enumerate(_NAMES):
        on = Lambert(*ellipsoid(name), -97.0, 40.0, 33.0, 45.0)
        a, b = on.unproject(*on.project(F.col("lon"), F.col("lat")))
        here = F.col("event_id") % n == k
        lon, lat = (F.when(here, a), F.when(here, b)) if lon is None else (lon.when(here, a), lat.when(here, b))
    return p.select("event_id", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))
