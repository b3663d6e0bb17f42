"""Queries in which pixels meet flags, vectors, boxes and codes, and filters of files, levels and tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.functions import grid as G
from geoflume.functions import timecodes as T
from geoflume.operators import exact as E
from geoflume.operators import filters as FL
from geoflume.operators import joins as J
from geoflume.operators import regrid as R
from geoflume.operators import relations as Q
from geoflume.plans.points import ONE_DEGREE, POINTS_SQL, points, table
from geoflume.plans.registry import query

BOX = (-110.0, 28.0, -80.0, 45.0)
_PIXELS_SQL = "pixels AS (SELECT event_id // 400 AS granule, event_id % 400 // 40 AS row, event_id % 40 AS col, value FROM events)"


def pixels(spark, d):
    """Values of a swath of 10 rows by 40 columns a granule."""
    e = F.col("event_id")
    return table(spark, d, "events").select(F.floor(e / 400).alias("granule"), F.floor(e % 400 / 40).alias("row"), (e % 40).alias("col"), "value")


# --- joins -----------------------------------------------------------------


@query(f"""WITH {_PIXELS_SQL}, f AS (SELECT granule, row, col, (value * 100)::BIGINT % 3 AS flag, (value * 100)::BIGINT // 10 % 90 AS sza FROM pixels WHERE (granule + row + col) % 7 <> 0)
SELECT p.granule, p.row, p.col, CASE WHEN f.flag = 0 AND f.sza BETWEEN 0 AND 70 THEN p.value END AS value FROM pixels p LEFT JOIN f USING (granule, row, col)""")
def pixel_flag_join(spark, d):
    p = pixels(spark, d)
    side = p.filter((F.col("granule") + F.col("row") + F.col("col")) % 7 != 0)
    side = side.select("granule", "row", "col", (F.round(F.col("value") * 100).cast("long") % 3).alias("flag"), (F.floor(F.round(F.col("value") * 100) / 10) % 90).alias("sza"))
    both = J.with_side(p, side, ["granule", "row", "col"])
    return both.select("granule", "row", "col", FL.in_flag_range(FL.with_flags(F.col("value"), F.col("flag")), F.col("sza"), 0, 70).alias("value"))


@query(f"""WITH {_PIXELS_SQL}, v AS (SELECT range AS col, range * 3 % 41 AS ground FROM range(38))
SELECT granule, row, p.col, CASE WHEN ground BETWEEN 5 AND 35 THEN value END AS value, ground FROM pixels p LEFT JOIN v ON p.col = v.col""")
def ground_pixel_join(spark, d):
    vector = spark.range(38).select(F.col("id").alias("col"), (F.col("id") * 3 % 41).alias("ground"))
    return J.with_vector(pixels(spark, d), vector, "col").select("granule", "row", "col", FL.in_columns(F.col("value"), F.col("ground"), 5, 35).alias("value"), "ground")


@query("""SELECT s_suppkey, c_custkey, c_name FROM supplier JOIN (
  SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) ON s_nationkey = c_nationkey""")
def static_metadata_first(spark, d):
    requests = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    known = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name")
    return J.first_match(requests, known, ["nation"], ["c_custkey"]).select("s_suppkey", "c_custkey", "c_name")


_BOXES_SQL = """g AS (SELECT c_custkey AS granule, (c_custkey * 37 % 300)::DOUBLE - 150 AS west, (c_custkey * 53 % 140)::DOUBLE - 70 AS south FROM customer),
q AS (SELECT n_nationkey AS request, (n_nationkey * 11 % 300)::DOUBLE - 150 AS w, (n_nationkey * 7 % 140)::DOUBLE - 70 AS s FROM nation)"""


@query(f"""WITH {_BOXES_SQL} SELECT granule, request FROM g, q WHERE west <= w + 25 AND west + 8 >= w AND south <= s + 15 AND south + 4 >= s""")
def granule_requests(spark, d):
    k = F.col("c_custkey")
    g = table(spark, d, "customer").select(k.alias("granule"), (k * 37 % 300 - 150).cast("double").alias("west"), (k * 53 % 140 - 70).cast("double").alias("south"))
    n = F.col("n_nationkey")
    q = table(spark, d, "nation").select(n.alias("request"), (n * 11 % 300 - 150).cast("double").alias("r_west"), (n * 7 % 140 - 70).cast("double").alias("r_south"))
    g = g.withColumn("east", F.col("west") + 8).withColumn("north", F.col("south") + 4)
    q = q.withColumn("r_east", F.col("r_west") + 25).withColumn("r_north", F.col("r_south") + 15)
    return J.boxes_overlapping(g, q, 10.0).select("granule", "request")


@query("""WITH a AS (SELECT c_custkey AS a_id, CASE WHEN c_custkey % 10 <> 3 THEN c_custkey * 7 % 500 END AS lo, CASE WHEN c_custkey % 10 <> 4 THEN c_custkey * 7 % 500 + c_custkey % 20 END AS hi FROM customer),
b AS (SELECT s_suppkey AS b_id, CASE WHEN s_suppkey % 5 <> 1 THEN s_suppkey * 13 % 500 END AS s, CASE WHEN s_suppkey % 5 <> 2 THEN s_suppkey * 13 % 500 + 9 END AS e FROM supplier)
SELECT a_id, b_id FROM a, b WHERE (lo IS NULL OR e IS NULL OR lo <= e) AND (hi IS NULL OR s IS NULL OR hi >= s)""")
def open_interval_join(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, d, "customer").select(c.alias("a_id"), F.when(c % 10 != 3, c * 7 % 500).alias("lo"), F.when(c % 10 != 4, c * 7 % 500 + c % 20).alias("hi"))
    b = table(spark, d, "supplier").select(s.alias("b_id"), F.when(s % 5 != 1, s * 13 % 500).alias("start"), F.when(s % 5 != 2, s * 13 % 500 + 9).alias("end"))
    return J.overlapping(a, b, 25).select("a_id", "b_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 11 = 0)""")
def semi_join_ids(spark, d):
    masked = table(spark, d, "orders").filter("o_custkey % 11 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.only_ids(table(spark, d, "lineitem"), masked, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH {_PIXELS_SQL} SELECT granule, row, col, value, 100.0::DOUBLE * row + 30 AS altitude, 2024010100 + granule % 24 AS hour
FROM pixels WHERE 100.0::DOUBLE * row + 30 BETWEEN 200 AND 700""")
def profile_dimensions(spark, d):
    p = pixels(spark, d)
    altitude = spark.range(10).select(F.col("id").alias("row"), (F.col("id") * 100.0 + 30).alias("altitude"))
    stamps = p.select("granule").distinct().withColumn("hour", F.lit(2024010100) + F.col("granule") % 24)
    both = J.with_vector(J.with_vector(p, altitude, "row"), stamps, "granule")
    return both.filter(F.col("altitude").between(200, 700)).select("granule", "row", "col", "value", "altitude", "hour")


@query(f"""WITH {_PIXELS_SQL}, u AS (SELECT * FROM pixels WHERE col % 2 = 0), v AS (SELECT granule, row, col - 1 AS col, value FROM pixels WHERE col % 2 = 1)
SELECT u.granule, u.row, u.col, round(sqrt(u.value * u.value + v.value * v.value), 6) AS speed,
  round(((degrees(atan2(-u.value, -v.value)) + 360) % 360 + 360) % 360, 6) AS from_degrees FROM u JOIN v USING (granule, row, col)""")
def wind_components(spark, d):
    p = pixels(spark, d)
    out = J.components(p.filter("col % 2 = 0"), p.filter("col % 2 = 1").withColumn("col", F.col("col") - 1), ["granule", "row", "col"])
    return out.select("granule", "row", "col", F.round("speed", 6).alias("speed"), F.round("from_degrees", 6).alias("from_degrees"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders)
SELECT p.o_custkey AS site, p.a AS place, p.o_orderkey AS first, q.o_orderkey AS last FROM x p JOIN x q ON p.o_custkey = q.o_custkey AND p.a = q.b""")
def positional_zip(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey")
    one, two = o.withColumn("line", F.col("o_orderkey")), o.withColumn("line", -F.col("o_orderkey"))
    files = {n: x.withColumnRenamed("o_orderkey", "value") for n, x in (("first", one), ("last", two))}
    return J.zipped(files).select(F.col("path").alias("site"), F.col("place").cast("long").alias("place"), "first", "last")


@query("""SELECT event_id, CASE event_id % 30 WHEN 5 THEN 'light' WHEN 16 THEN 'medium' WHEN 27 THEN 'dense' END AS density FROM events""")
def code_lookup(spark, d):
    return table(spark, d, "events").select("event_id", J.named(F.col("event_id") % 30, J.SMOKE).alias("density"))


@query(f"""WITH {POINTS_SQL}, f AS (SELECT s_suppkey AS fid, (s_suppkey * 37 % 6000)::DOUBLE / 100 - 125 AS x, (s_suppkey * 53 % 2500)::DOUBLE / 100 + 25 AS y FROM supplier),
p AS (SELECT event_id, lon, lat FROM points),
n AS (SELECT event_id, fid, sqrt((lon - x) * (lon - x) + (lat - y) * (lat - y)) AS d FROM p, f)
SELECT p.event_id, b.fid FROM p LEFT JOIN (SELECT event_id, arg_min(fid, struct_pack(d := d, fid := fid)) AS fid FROM n WHERE d <= 1.5 GROUP BY event_id) b USING (event_id)""")
def nearest_feature_all(spark, d):
    s = F.col("s_suppkey")
    f = table(spark, d, "supplier").select(s.alias("fid"), (s * 37 % 6000 / 100 - 125).alias("flon"), (s * 53 % 2500 / 100 + 25).alias("flat"))
    p = points(spark, d).select("event_id", "lon", "lat")
    return J.nearest_feature(p, f, 1.5, "left").select("event_id", "fid")


# --- filters ---------------------------------------------------------------


@query("""SELECT event_id, value FROM points WHERE value IS NOT NULL AND value > 0 AND lon - 0.3::DOUBLE <= -80 AND lon + 0.4::DOUBLE >= -110 AND lat - 0.2::DOUBLE <= 45 AND lat + 0.5::DOUBLE >= 28""")
def corner_box_filter(spark, d):
    x, y = F.col("lon"), F.col("lat")
    inside = FL.corners_in_box([x - 0.3, x + 0.4, x + 0.1, x], [y - 0.2, y, y + 0.5, y + 0.1], BOX)
    return points(spark, d).filter(F.col("value").isNotNull() & (F.col("value") > 0) & inside).select("event_id", "value")


@query(f"""WITH {POINTS_SQL}, l AS (SELECT event_id, lon, lat, unnest([0, 1, 2, 3, 4]) AS level, value FROM points)
SELECT event_id, level, level * 250.0::DOUBLE - 100 AS elevation, round(value + level, 6) AS value FROM l
WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45 AND level * 250.0 - 100 BETWEEN 0 AND 700 AND (event_id + level) % 4 <> 0 AND value IS NOT NULL""")
def profile_level_filter(spark, d):
    p = points(spark, d).filter(FL.in_box(F.col("lon"), F.col("lat"), BOX))
    levels = [F.lit(i) for i in range(5)]
    p = p.select("event_id", F.array(*[i * 250.0 - 100 for i in levels]).alias("elevations"), F.array(*[F.when((F.col("event_id") + i) % 4 != 0, F.round(F.col("value") + i, 6)) for i in levels]).alias("values"))
    return FL.levels_between(p, "elevations", "values", 0.0, 700.0).select("event_id", "level", "elevation", "value")


@query("""SELECT o_orderkey FROM orders WHERE 'V0' || (o_orderkey % 5) >= 'V03' OR strftime(o_orderdate, '%Y%m%d')::BIGINT IN (19950802, 19960809) OR strftime(o_orderdate, '%Y%m%d')::BIGINT BETWEEN 19971217 AND 19971230""")
def version_gate(spark, d):
    version = F.concat(F.lit("V0"), (F.col("o_orderkey") % 5).cast("string"))
    return table(spark, d, "orders").filter(FL.released(version, T.pack(F.col("o_orderdate"), "yyyyMMdd"), "V03", (19950802, 19960809), ((19971217, 19971230),))).select("o_orderkey")


@query("""SELECT event_id FROM points WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') BETWEEN '2024-01-03T00:00:00Z' AND '2024-01-04T12:00:00Z'""")
def time_text_range(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return points(spark, d).filter(FL.at_times(text, "2024-01-03T00:00:00Z/2024-01-04T12:00:00Z")).select("event_id")


@query("""SELECT event_id, CASE WHEN value BETWEEN -0.05 AND 5 THEN value END AS aod, CASE WHEN value / 100 BETWEEN -1 AND 3 THEN round(value / 100, 6) END AS exponent,
  CASE WHEN value * 10000 BETWEEN 0 AND 540000 THEN round(value * 10000, 6) END AS backscatter, CASE WHEN value * 400 - 1000 BETWEEN -500 AND 1e5 THEN round(value * 400 - 1000, 6) END AS height FROM events""")
def valid_ranges(spark, d):
    v = F.col("value")
    raw = {"aod": (v, "aod550"), "exponent": (v / 100, "angstrom"), "backscatter": (v * 10000, "backscatter"), "height": (v * 400 - 1000, "height")}
    return table(spark, d, "events").select("event_id", *[F.round(FL.in_range_of(x, name), 6).alias(n) if n != "aod" else FL.in_range_of(x, name).alias(n) for n, (x, name) in raw.items()])


@query("""SELECT event_id, value FROM events WHERE value IS NOT NULL AND event_id % 9 <> 2 AND ts IS NOT NULL AND event_id % 13 <> 5""")
def complete_rows(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(e % 9 != 2, F.col("value")).alias("value"), F.when(e % 13 != 5, F.lit(" x")).otherwise("").alias("elevation"), "ts")
    return FL.complete(rows, "value", "elevation", "ts").select("event_id", "value")


@query("""SELECT event_id, CASE WHEN event_id % 101 >= 20 AND (event_id % 7) * 0.1::DOUBLE BETWEEN 0 AND 0.45 THEN value END AS value FROM events""")
def score_and_uncertainty(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", FL.scored(F.col("value"), e % 101, 20, (e % 7) * F.lit(0.1), 0.45).alias("value"))


@query("""SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 0""")
def analyte_rows(spark, d):
    return FL.of_analyte(table(spark, d, "events").select("event_id", "event_type", "value"), "click", "event_type")[["event_id", "value"]]


@query("""SELECT event_id FROM points WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45""")
def header_located_box(spark, d):
    named = points(spark, d).select("event_id", F.col("lon").cast("string").alias("Site Longitude(deg)"), F.col("lat").cast("string").alias("Site Latitude(deg)"))
    return FL.in_named_box(named, BOX).select("event_id")


@query("""SELECT c_custkey, c_name FROM customer""")
def drop_numbered_columns(spark, d):
    wide = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("HRU1"), F.col("c_acctbal").alias("HRU_12"), "c_name")
    return FL.without_numbered(wide)


@query(f"""WITH {_BOXES_SQL} SELECT granule FROM g WHERE west <= 20 AND west + 8 >= -30 AND south <= 10 AND south + 4 >= -10""")
def shape_bounds_mask(spark, d):
    k = F.col("c_custkey")
    a = {"west": (k * 37 % 300 - 150).cast("double"), "south": (k * 53 % 140 - 70).cast("double")}
    a |= {"east": a["west"] + 8, "north": a["south"] + 4}
    box = dict(zip(("west", "south", "east", "north"), (F.lit(x) for x in (-30.0, -10.0, 20.0, 10.0))))
    return table(spark, d, "customer").filter(G.boxes_overlap(a, box)).select(k.alias("granule"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND (o_custkey % 50 BETWEEN 10 AND 20 OR o_custkey IN (3, 7, 31))""")
def table_subset(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 50).alias("zone"))
    dated = Q.subset(o, {"day": (dt.date(1995, 1, 1), dt.date(1996, 6, 30))})
    return dated.filter(F.col("zone").between(10, 20) | F.col("o_custkey").isin(3, 7, 31)).select("o_orderkey")


@query("""SELECT event_id, value, value * 2 + 135.5 AS elevation FROM events WHERE event_id % 2 = 1""")
def heights_above_sea(spark, d):
    """The value stays above ground; the elevation axis is above mean sea level. Sensors that stand outdoors only."""
    e = table(spark, d, "events").withColumn("location_type", F.col("event_id") % 2)
    return e.filter(FL.is_id(F.col("location_type"), 1)).select("event_id", "value", (F.col("value") * 2 + 135.5).alias("elevation"))


# --- aggregates, order, sets ------------------------------------------------

_CELL_SQL = "floor(lon + 125.0::DOUBLE)::INTEGER AS col, floor(lat - 25.0::DOUBLE)::INTEGER AS row"
_IN_GRID = "floor(lon + 125.0::DOUBLE) BETWEEN 0 AND 59 AND floor(lat - 25.0::DOUBLE) BETWEEN 0 AND 24"


@query(f"""SELECT layer, row, col, round(avg(u), 6) AS mean_u, round(avg(v), 6) AS mean_v, count(*) AS n FROM (
  SELECT event_id % 3 AS layer, {_CELL_SQL}, value AS u, value * 2 - 1 AS v FROM points WHERE {_IN_GRID} AND value IS NOT NULL) GROUP BY ALL""")
def regrid_layers_two_components(spark, d):
    p = points(spark, d).filter("value is not null").withColumn("layer", F.col("event_id") % 3)
    cells = R.to_cells(p, ONE_DEGREE)
    return cells.groupBy("layer", "row", "col").agg(F.round(F.avg("value"), 6).alias("mean_u"), F.round(F.avg(F.col("value") * 2 - 1), 6).alias("mean_v"), F.count("*").alias("n"))


_MONTHLY = f"SELECT strftime(ts, '%Y%m')::BIGINT AS month, {_CELL_SQL}, strftime(ts, '%Y%m%d')::BIGINT AS day, value FROM points WHERE {_IN_GRID} AND value IS NOT NULL"


@query(f"SELECT month, row, col, round(avg(v), 6) AS value, sum(n)::BIGINT AS n FROM (SELECT month, day, row, col, avg(value) AS v, count(*) AS n FROM ({_MONTHLY}) GROUP BY ALL) GROUP BY month, row, col")
def monthly_grid_mean(spark, d):
    """Mean of daily cell means by month."""
    p = points(spark, d).withColumn("month", T.pack(F.col("ts"), "yyyyMM")).withColumn("day", T.pack(F.col("ts"), "yyyyMMdd"))
    daily = R.regrid(p, ONE_DEGREE, "mean", ["month", "day"])
    return daily.groupBy("month", "row", "col").agg(F.round(F.avg("value"), 6).alias("value"), F.sum("n").alias("n"))


@query("""SELECT round(lon, 2) AS lon, round(lat, 2) AS lat, strftime(ts, '%Y%m%d')::BIGINT AS day, round(avg(value * 1e9) / 1e9, 6) AS value FROM points GROUP BY 1, 2, 3""")
def scaled_daily_mean(spark, d):
    p = points(spark, d)
    by = [F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), T.pack(F.col("ts"), "yyyyMMdd").alias("day")]
    return p.groupBy(*by).agg(F.round(F.avg(F.col("value") * 1e9) / 1e9, 6).alias("value"))


@query("""SELECT user_id AS station, sum(value::DECIMAL(18, 6))::DECIMAL(38, 6)::VARCHAR AS total FROM events GROUP BY 1""")
def exact_sum(spark, d):
    """Sums of decimals: the same in any order, as compensated summing aims at."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("station")).agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(38,6)").cast("string").alias("total"))


@query("""SELECT 'event_id' AS name, min(event_id)::DOUBLE AS least, max(event_id)::DOUBLE AS most, count(event_id) AS n FROM events
UNION ALL SELECT 'user_id', min(user_id), max(user_id), count(user_id) FROM events UNION ALL SELECT 'value', min(value), max(value), count(value) FROM events""")
def column_ranges(spark, d):
    return Q.ranges(table(spark, d, "events"), ["event_id", "user_id", "value"])


@query("""SELECT o_orderkey, rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(o_orderkey::VARCHAR, 12, '0')) AS place FROM orders""")
def rows_in_text_order(spark, d):
    """All rows in the order of their text, ISO time first, with their places."""
    key = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return E.placed(table(spark, d, "orders").select("o_orderkey", key.alias("line")), [F.col("line")]).select("o_orderkey", "place")


@query("""WITH t AS (SELECT user_id AS station, sum(CAST(value * 1180591620717411303424::DOUBLE AS HUGEINT)) AS h FROM events GROUP BY 1),
cut AS (SELECT station, h::HUGEINT AS h, CAST(pow(2::DOUBLE, greatest(floor(log2(h::DOUBLE)) - 52, 0)) AS HUGEINT) AS p FROM t)
SELECT station, (h // p + CASE WHEN 2 * (h % p) > p OR (2 * (h % p) = p AND (h // p) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE * p::DOUBLE / 1180591620717411303424::DOUBLE AS total FROM cut""")
def exact_double_sum(spark, d):
    """Sums of doubles with one rounding: the same bits however the rows are dealt."""
    return E.exact_sum(table(spark, d, "events").withColumnRenamed("user_id", "station").repartition(13), ["station"], "value")


@query("""SELECT path, field, row_number() OVER (PARTITION BY nation ORDER BY field, path) AS place FROM (
  SELECT c_nationkey AS nation, 'a_b_c_d_' || lpad((c_custkey * 7919 % 10007)::VARCHAR, 6, '0') || '_' || c_custkey || '.nc' AS path, lpad((c_custkey * 7919 % 10007)::VARCHAR, 6, '0') AS field FROM customer)""")
def files_by_field(spark, d):
    c = table(spark, d, "customer")
    path = F.concat_ws("_", F.lit("a_b_c_d"), F.lpad((F.col("c_custkey") * 7919 % 10007).cast("string"), 6, "0"), F.concat(F.col("c_custkey").cast("string"), F.lit(".nc")))
    files = Q.by_field(c.select(F.col("c_nationkey").alias("nation"), path.alias("path")), ["nation"], 5)
    return files.select("path", "field", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_PIXELS_SQL} SELECT granule, 9 - row AS row, col, col AS t_row, row AS t_col, value FROM pixels""")
def reversed_and_transposed(spark, d):
    p = pixels(spark, d).withColumns({"t_row": F.col("row"), "t_col": F.col("col")})
    return Q.transposed(Q.flipped(p, 10), "t_row", "t_col").select("granule", "row", "col", "t_row", "t_col", "value")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || event_id)) AS place FROM events""")
def seeded_shuffle(spark, d):
    return Q.shuffled(table(spark, d, "events"), ["user_id"], "event_id", 7).select("event_id", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS page FROM orders""")
def paged_rows(spark, d):
    return Q.paged(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "page")


@query(f"""WITH {_PIXELS_SQL}, n AS (SELECT granule, max(row) + 1 AS n FROM pixels GROUP BY 1), b AS (SELECT granule, coalesce(sum(n) OVER (ORDER BY granule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT granule, row, col, (row + before)::BIGINT AS scan, value FROM pixels JOIN b USING (granule)""")
def swaths_in_sequence(spark, d):
    """All swaths as one, their rows numbered on from swath to swath."""
    out = Q.in_sequence(pixels(spark, d), "granule", F.col("granule"))
    return out.select("granule", "row", "col", F.col("scan").cast("long").alias("scan"), "value")


@query("""SELECT station, strftime(ts, '%Y%m%d')::BIGINT AS day, round(sum(round(value * 1e9, 0)::DECIMAL(28, 6))::DOUBLE / count(value), 3) AS value, count(value) AS n FROM points GROUP BY ALL""")
def scaled_mean_any_order(spark, d):
    """Daily means in billionths, added up as whole numbers."""
    p = points(spark, d).withColumn("day", T.pack(F.col("ts"), "yyyyMMdd"))
    return Q.scaled_mean(p, ["station", "day"], "value", 1e9).select("station", "day", F.round("value", 3).alias("value"), "n")


@query("""SELECT event_id, value, value * 2 + s_suppkey % 40 * 12.5::DOUBLE AS elevation FROM events LEFT JOIN supplier ON user_id = s_suppkey""")
def levels_above_sea(spark, d):
    """Heights above the ground of each station, above sea; null where the station's ground isn't known."""
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 40 * 12.5).alias("ground"))
    return Q.above_sea(table(spark, d, "events"), sites, "user_id", F.col("value") * 2).select("event_id", "value", "elevation")


@query("""SELECT 'hourly_mean_value' AS name, station, strftime(ts, '%Y%m%d%H')::BIGINT AS start, round(avg(value), 6) AS value FROM points GROUP BY ALL
UNION ALL SELECT 'daily_mean_value', station, strftime(ts, '%Y%m%d')::BIGINT * 100, round(avg(value), 6) FROM points GROUP BY ALL""")
def named_means(spark, d):
    cuts = {"hourly": T.pack(F.col("ts"), "yyyyMMddHH"), "daily": T.pack(F.col("ts"), "yyyyMMdd") * 100}
    return Q.named(points(spark, d), cuts, ["station"], "value").select("name", "station", "start", F.round("value", 6).alias("value"))


@query(f"""WITH {_PIXELS_SQL} SELECT granule, count(*) AS points, max(row) + 1 AS scans, (SELECT count(*) FROM pixels) AS all_points FROM pixels GROUP BY granule""")
def merged_swaths(spark, d):
    p = pixels(spark, d)
    each = p.filter("granule % 2 = 0").unionByName(p.filter("granule % 2 = 1")).groupBy("granule").agg(F.count("*").alias("points"), (F.max("row") + 1).alias("scans"))
    return J.with_vector(each.withColumn("one", F.lit(1)), each.groupBy().agg(F.sum("points").alias("all_points")).withColumn("one", F.lit(1)), "one").drop("one")


@query("""SELECT period || '_mean_' || 'value' AS name, round(avg(v), 6) AS value FROM (
  SELECT 'hourly' AS period, value AS v FROM points UNION ALL SELECT 'daily', d FROM (SELECT avg(value) AS d FROM points GROUP BY strftime(ts, '%Y%m%d'))) GROUP BY 1""")
def named_by_period(spark, d):
    p = points(spark, d)
    daily = p.groupBy(T.pack(F.col("ts"), "yyyyMMdd")).agg(F.avg("value").alias("v")).select(F.lit("daily").alias("period"), "v")
    both = p.select(F.lit("hourly").alias("period"), F.col("value").alias("v")).unionByName(daily)
    return both.groupBy(F.concat("period", F.lit("_mean_value")).alias("name")).agg(F.round(F.avg("v"), 6).alias("value"))
