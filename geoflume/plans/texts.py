"""Queries of coordinate files, descriptions, dumps and lines of one width."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflume.functions import timecodes as T
from geoflume.operators import joins as J
from geoflume.plans.formats import folder
from geoflume.plans.points import points
from geoflume.plans.registry import query
from geoflume.sources import numbered as N
from geoflume.sources import record_files as R
from geoflume.sources import tables as S
from geoflume.sources import text_sinks as K


@query("""WITH points AS (SELECT event_id, (user_id * 37 % 6000)::DOUBLE / 100.0::DOUBLE - 125.0::DOUBLE AS lon, (user_id * 53 % 2500)::DOUBLE / 100.0::DOUBLE + 25.0::DOUBLE AS lat, value,
  event_id // 400 AS granule, event_id % 400 // 40 AS row, event_id % 40 AS col FROM events),
whole AS (SELECT granule FROM points GROUP BY 1 HAVING count(*) = 400 AND granule % 5 <> 3)
SELECT granule, row, col, lon, lat, value FROM points SEMI JOIN whole USING (granule)""")
def side_file_pixels(spark, d):
    """Swaths of 10 rows by 40 columns whose places stand in a coordinate file each; every fifth file has a point off the globe, the last has too few, and these have no places."""
    at, e = folder(spark), F.col("event_id")
    p = points(spark, d).select(F.floor(e / 400).alias("granule"), F.floor(e % 400 / 40).alias("row"), (e % 40).alias("col"), "lon", "lat", "value")
    bad = (F.col("granule") % 5 == 3) & (F.col("row") == 4) & (F.col("col") == 7)
    body = p.select("granule", (F.col("row") * 40 + F.col("col")).alias("n"), F.concat_ws(" ", F.col("col") + 1, F.col("row") + 1, F.when(bad, 95.0).otherwise(F.col("lat")), "lon").alias("line"))
    head = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("line")) for n, x in ((-4, "hdr_lines: 4"), (-3, "NX (columns): 40"), (-2, "NY (rows): 10"), (-1, "x y latitude longitude"))]))
    heads = p.select("granule").distinct().select("granule", head.alias("h")).select("granule", F.col("h.n").cast("long").alias("n"), "h.line")
    # version 2: each task moves its own files, not the driver all of them one by one
    body.unionByName(heads).repartition("granule").sortWithinPartitions("granule", "n").select("granule", "line").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("granule").text(at)
    side = N.coordinates(spark, at).withColumn("granule", F.regexp_extract("file", r"granule=(\d+)", 1).cast("long")).drop("file")
    return J.with_side(p.drop("lon", "lat"), side, ["granule", "row", "col"]).filter("lon is not null").select("granule", "row", "col", "lon", "lat", "value")


@query("""SELECT variable, '<CoverageOffering>' || label || '<domainSet><spatialDomain><gml:Envelope srsName="WGS84(DD)">' || printf('<gml:pos>%.2f %.2f</gml:pos><gml:pos>%.2f %.2f</gml:pos>', west, south, east, north) ||
  '</gml:Envelope></spatialDomain><temporalDomain><timePeriod><beginPosition>' || strftime(first, '%Y-%m-%dT%H:%M:%SZ') || '</beginPosition><endPosition>' || strftime(last, '%Y-%m-%dT%H:%M:%SZ') ||
  '</endPosition><timeResolution>PT1H</timeResolution></timePeriod></temporalDomain></domainSet><rangeSet><RangeSet>' || label || '<nullValues><singleValue>-9999.0</singleValue></nullValues></RangeSet></rangeSet></CoverageOffering>' AS line
FROM (SELECT variable, '<name>' || variable || '</name><label>' || variable || '(ug/m3)</label><description>' || variable || ' &lt;mean &amp; count&gt;</description>' AS label,
  min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, min(ts) AS first, max(ts) AS last FROM points GROUP BY variable)""")
def coverage_descriptions(spark, d):
    found = K.extents(points(spark, d), "variable")
    return K.descriptions(found.withColumns({"units": F.lit("ug/m3"), "description": F.concat("variable", F.lit(" <mean & count>"))}))


@query("""SELECT event_id, 'stamp' AS variable, printf('%g', strftime(ts, '%Y%m%d%H%M%S')::DOUBLE) AS line FROM points WHERE value IS NOT NULL UNION ALL
SELECT event_id, 'lon', printf('%g', lon) FROM points WHERE value IS NOT NULL UNION ALL SELECT event_id, 'lat', printf('%g', lat) FROM points WHERE value IS NOT NULL UNION ALL
SELECT event_id, 'elevation', printf('%g', value / 30000) FROM points WHERE value IS NOT NULL UNION ALL SELECT event_id, 'value', printf('%g', value) FROM points WHERE value IS NOT NULL""")
def dumped_points(spark, d):
    """Point streams written, read and dumped as text."""
    at = folder(R.register(spark))
    rows = points(spark, d).filter("value is not null")
    rows = rows.select(F.lit("").alias("note"), T.pack(F.col("ts"), "yyyyMMddHHmmss").alias("stamp"), "lon", "lat", (F.col("value") / 30000).alias("elevation"), F.col("event_id").alias("id"), "value")
    R.write_points(rows, at, "pm25", "ug/m3", "2024-01-01T00:00:00-0000")
    back = R.read_points(spark, at).withColumn("event_id", F.col("id").cast("long"))
    return K.dump(back, ["event_id"], ["stamp", "lon", "lat", "elevation", "value"])


@query("""SELECT printf('%s,%s,%010.5f,%09.5f,%09.3f,%010.4f', strftime(ts, '%Y/%m/%d'), lpad(event_id::VARCHAR, 11, '0'), lon, lat, value, value / 4) AS line FROM points WHERE event_id % 9 <> 4 AND value IS NOT NULL""")
def surface_lines(spark, d):
    """Lines with month names, some unreadable and headers among them, become lines of one width."""
    at = folder(spark)
    day = F.when(F.col("event_id") % 9 != 4, F.date_format("ts", "MMM-dd-yyyy")).otherwise("Xyz-41-2024")
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = points(spark, d).select(F.concat_ws(",", day, F.col("event_id").cast("string"), number(F.col("lat")), number(F.col("lon")), number(F.col("value")), number(F.col("value") / 4)).alias("line"))
    rows.unionByName(spark.range(3).select(F.lit("Date,FIPS,Latitude,Longitude,o3,o3_stderr").alias("line"))).write.text(at)
    return S.surface_lines(spark, at)
