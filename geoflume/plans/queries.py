"""Queries over the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.functions import grid as G
from geoflume.functions import text as X
from geoflume.functions import timecodes as T
from geoflume.functions import units as U
from geoflume.functions.projection import Albers, Lambert, Mercator, Stereographic
from geoflume.operators import filters as FL
from geoflume.operators import joins as J
from geoflume.operators import regrid as R
from geoflume.plans import formats, relations, scalars, shapes, streams, surveys, texts  # noqa: F401 - they register queries of their own
from geoflume.plans.points import LAMBERT, ONE_DEGREE, POINTS_SQL, points, table
from geoflume.plans.registry import ORACLE, QUERIES, query  # noqa: F401

BOX = (-110.0, 28.0, -80.0, 45.0)
_HOUR_SQL = "strftime(ts, '%Y%m%d%H')::BIGINT"
_DAY_SQL = "strftime(ts, '%Y%m%d')::BIGINT"


def hour(ts="ts"):
    return T.pack(F.col(ts)).alias("hour")


def day(ts="ts"):
    return T.pack(F.col(ts), "yyyyMMdd").alias("day")


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- filters ---------------------------------------------------------------


@query(f"SELECT event_id, {_HOUR_SQL} AS hour, lon, lat, value FROM points WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45 AND ts BETWEEN '2024-01-05' AND '2024-01-20'")
def box_time_subset(spark, d):
    p = points(spark, d)
    times = FL.in_time(F.col("ts"), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return p.filter(FL.in_box(F.col("lon"), F.col("lat"), BOX) & times).select("event_id", hour(), "lon", "lat", "value")


@query("SELECT event_id, station, value FROM points WHERE station = 17")
def sensor_subset(spark, d):
    return points(spark, d).filter(FL.is_id(F.col("station"), 17)).select("event_id", "station", "value")


@query("SELECT event_id, CASE WHEN value * 0.01::DOUBLE BETWEEN 0.05 AND 1.5 THEN value * 0.01::DOUBLE END AS scaled, CASE WHEN (value - 60) * 2 BETWEEN -1e29 AND 100 THEN (value - 60) * 2 END AS signed FROM points")
def scale_range_filter(spark, d):
    v = F.col("value")
    return points(spark, d).select("event_id", FL.scaled(v, 0.01, 0.05, 1.5).alias("scaled"), FL.scaled(v - 60, 2.0, 0.0, 100.0, "molecules/cm2", True).alias("signed"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 = 0 AND (event_id % 11)::DOUBLE / 10 BETWEEN 0 AND 0.4
  AND event_id % 101 BETWEEN 50 AND 100 AND event_id % 60 BETWEEN 5 AND 54 THEN value END AS value FROM points""")
def qc_flag_filter(spark, d):
    e = F.col("event_id")
    v = FL.at_least_quality(F.col("value"), e % 101, 50)
    v = FL.in_columns(FL.at_most_cloud(v, (e % 11) / 10.0, 0.4), e % 60, 5, 54)
    return points(spark, d).select("event_id", FL.with_flags(v, e % 2, e % 5).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 300 BETWEEN 10 AND 250 THEN ((event_id % 300) - 5)::DOUBLE * 0.25::DOUBLE END AS decoded,
  ((event_id % 300) - 5)::DOUBLE * 0.25::DOUBLE AS unranged, greatest(value - 1050, -999) AS floored,
  CASE WHEN event_id % 4 IN (3, 2) THEN value END AS medium FROM points""")
def decode_filter(spark, d):
    e = F.col("event_id") % 300
    high = FL.high_code(F.lit("quality 0: low, 3: high"))
    return points(spark, d).select("event_id", FL.decoded(e, 5.0, 0.25, 10, 250).alias("decoded"), FL.decoded(e, 5.0, 0.25, 1, 0).alias("unranged"), FL.floored(F.col("value") - 1050.0).alias("floored"), FL.of_quality(F.col("value"), F.col("event_id") % 4, high, True).alias("medium"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM points")
def sentinel_to_null(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.element_at(F.array(*[F.lit(float(x)) for x in (*FL.SENTINELS, "nan", 1e31)]), (F.col("event_id") % 5 + 1).cast("int"))).otherwise(F.col("value"))
    return points(spark, d).select("event_id", FL.null_missing(raw).alias("value"))


@query("""SELECT station, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS k FROM points) WHERE k % 10 = 0""")
def stride_thin(spark, d):
    return FL.stride(points(spark, d), 10, ["ts", "event_id"], ["station"]).select("station", "event_id", "value")


@query("""SELECT station, event_id FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS k,
  greatest(1, ceil(count(*) OVER (PARTITION BY station) / 20.0)) AS n FROM points) WHERE k % n = 0""")
def sparse_thin(spark, d):
    return FL.sparse(points(spark, d), 20, ["ts", "event_id"], ["station"]).select("station", "event_id")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders),
q AS (SELECT *, lag(o_orderdate) OVER w AS b, lag(o_orderdate, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey FROM q WHERE b IS NULL OR coalesce(b < c, false) OR o_orderdate >= b""")
def monotonic_filter(spark, d):
    return FL.monotonic(table(spark, d, "orders"), "o_orderkey", "o_orderdate", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT station, min(event_id % 40) AS col_min, max(event_id % 40) AS col_max, min(event_id % 25) AS row_min, max(event_id % 25) AS row_max
FROM points WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45 GROUP BY station""")
def index_window(spark, d):
    p = points(spark, d).withColumn("row", F.col("event_id") % 25).withColumn("col", F.col("event_id") % 40)
    return FL.index_window(p, "lon", "lat", BOX, ["station"])


@query("""WITH l AS (SELECT o_custkey AS path, CASE WHEN o_orderkey % 50 = 0 THEN 'a,b' ELSE 'a,b,c' END AS line, o_orderkey FROM orders)
SELECT path, o_orderkey FROM l WHERE path NOT IN (SELECT path FROM l GROUP BY path HAVING min(len(string_split(line, ','))) < 3)""")
def malformed_file_guard(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderkey") % 50 == 0, "a,b").otherwise("a,b,c").alias("line"), "o_orderkey")
    return FL.whole_files(rows, "path", "line", 3).select("path", "o_orderkey")


@query("""SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'BUIL') THEN c_name END AS layer, strpos(c_name || '_MID', '_MID') > 1 AS mid FROM customer WHERE starts_with(c_mktsegment, 'BUIL') OR c_custkey % 2 = 0""")
def layer_prefix(spark, d):
    s = FL.starts_with(F.col("c_mktsegment"), "BUIL")
    return table(spark, d, "customer").filter(s | (F.col("c_custkey") % 2 == 0)).select("c_custkey", F.when(s, F.col("c_name")).alias("layer"), FL.has_level(F.concat("c_name", F.lit("_MID")), "MID").alias("mid"))


# --- regridding ------------------------------------------------------------

_CELLS = "cells AS (SELECT *, floor((lon + 125.0::DOUBLE) / 1.0)::INTEGER AS col, floor((lat - 25.0::DOUBLE) / 1.0)::INTEGER AS row FROM points WHERE floor((lon + 125.0::DOUBLE)) BETWEEN 0 AND 59 AND floor((lat - 25.0::DOUBLE)) BETWEEN 0 AND 24)"
_D2 = "((lon + 125.0::DOUBLE) / 1.0 - col - 0.5::DOUBLE) * ((lon + 125.0::DOUBLE) / 1.0 - col - 0.5::DOUBLE) + ((lat - 25.0::DOUBLE) / 1.0 - row - 0.5::DOUBLE) * ((lat - 25.0::DOUBLE) / 1.0 - row - 0.5::DOUBLE)"


def _regrid(method):
    def run(spark, d):
        out = R.regrid(points(spark, d).withColumn("day", day()), ONE_DEGREE, method, ["variable", "day"], least=1.0, order="event_id")
        return out.select("variable", "day", "row", "col", r6(F.col("value"), "value"), "n")

    return run


for _name, _how in (("mean", "avg(value)"), ("nearest", f"arg_min(value, ({_D2}, event_id))"), ("weighted", f"sum(value / greatest({_D2}, 1e-6)) / sum(1 / greatest({_D2}, 1e-6))")):
    query(f"WITH {POINTS_SQL}, {_CELLS} SELECT variable, {_DAY_SQL} AS day, row, col, round({_how}, 6) AS value, count(*) AS n FROM cells WHERE value >= 1 GROUP BY ALL", f"regrid_{_name}")(_regrid(_name))


@query("""SELECT variable, row, col, round(avg(value), 6) AS value, count(*) AS n FROM (
  SELECT *, floor((x + 2916000.0::DOUBLE) / 108000.0::DOUBLE)::INTEGER AS col, floor((y + 2052000.0::DOUBLE) / 108000.0::DOUBLE)::INTEGER AS row FROM (
    SELECT variable, value, rho * sin(theta) AS x, rho0 - rho * cos(theta) AS y FROM (
      SELECT variable, value, c.rho0, c.f * pow(tan(pi() / 4 - radians(lat) / 2), c.n) AS rho, c.n * radians(lon + 97) AS theta FROM points,
        (SELECT n, f, f * pow(tan(pi() / 4 - radians(40) / 2), n) AS rho0 FROM (SELECT n, 6370000.0::DOUBLE * cos(radians(33)) / (n * pow(tan(pi() / 4 - radians(33) / 2), n)) AS f FROM
          (SELECT ln(cos(radians(33)) / cos(radians(45))) / ln(tan(pi() / 4 - radians(33) / 2) / tan(pi() / 4 - radians(45) / 2)) AS n))) c)))
WHERE col BETWEEN 0 AND 53 AND row BETWEEN 0 AND 37 GROUP BY ALL""")
def regrid_lambert_mean(spark, d):
    return R.regrid(points(spark, d), LAMBERT, "mean", ["variable"]).select("variable", "row", "col", r6(F.col("value"), "value"), "n")


def _hourly_cells(spark, d):
    return R.regrid(points(spark, d).withColumn("ts", F.date_trunc("hour", "ts")), ONE_DEGREE, "mean", ["ts"])


_HOURLY = f"{POINTS_SQL}, {_CELLS}, h AS (SELECT date_trunc('hour', ts) AS ts, row, col, avg(value) AS value, count(*) AS n FROM cells GROUP BY ALL)"


@query(f"WITH {_HOURLY} SELECT {_DAY_SQL} AS day, row, col, round(avg(value), 6) AS value, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def reaggregate_daily(spark, d):
    return R.reaggregate(_hourly_cells(spark, d), "ts", "daily").select(day(), "row", "col", r6(F.col("value"), "value"), "n")


@query(f"WITH {_HOURLY} SELECT row, col, round(avg(value), 6) AS value, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def reaggregate_all(spark, d):
    return R.reaggregate(_hourly_cells(spark, d), "ts", "all").select("row", "col", r6(F.col("value"), "value"), "n")


@query(f"""WITH {_HOURLY}, w AS (SELECT ts, row, col, value FROM h)
SELECT strftime(t.ts, '%Y%m%d%H')::BIGINT AS hour, g.row, g.col, coalesce(round(w.value, 6) * 10, -9999) AS value
FROM (SELECT DISTINCT ts FROM w) t, (SELECT (i // 60)::INTEGER AS row, (i % 60)::INTEGER AS col FROM range(1500) r(i)) g LEFT JOIN w ON w.ts = t.ts AND w.row = g.row AND w.col = g.col""")
def densify_grid(spark, d):
    cells = _hourly_cells(spark, d).withColumn("value", F.round("value", 6))
    return R.densify(cells, ONE_DEGREE, cells, "ts", scale=10.0, missing=-9999.0).select(hour(), "row", "col", "value")


@query(f"""WITH {_HOURLY}
SELECT strftime(t.ts, '%Y%m%d%H')::BIGINT AS hour, g.row, g.col, coalesce(round(h.value, 6) * 10, -9999) AS value
FROM (SELECT DISTINCT ts FROM h) t, (SELECT (i // 60)::INTEGER AS row, (i % 60)::INTEGER AS col FROM range(1500) r(i)) g LEFT JOIN h ON h.ts = t.ts AND h.row = g.row AND h.col = g.col""")
def densify_grid_all(spark, d):
    """As densify_grid, which had one day only once."""
    cells = _hourly_cells(spark, d).withColumn("value", F.round("value", 6))
    return R.densify(cells, ONE_DEGREE, cells, "ts", scale=10.0, missing=-9999.0).select(hour(), "row", "col", "value")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS value, (l_partkey % 50)::DOUBLE + 0.25::DOUBLE AS x, (l_suppkey % 20)::DOUBLE + 0.5::DOUBLE AS y, 0.5::DOUBLE + (l_linenumber % 3)::DOUBLE * 0.5::DOUBLE AS s FROM lineitem),
c AS (SELECT q.*, g.col, g.row, (greatest(0, least(x + s, g.col + 1) - greatest(x, g.col)) * greatest(0, least(y + s, g.row + 1) - greatest(y, g.row))) / (s * s) AS share
  FROM q, (SELECT (i % 60)::INTEGER AS col, (i // 60)::INTEGER AS row FROM range(1500) r(i)) g WHERE g.col < x + s AND g.col + 1 > x AND g.row < y + s AND g.row + 1 > y)
SELECT row, col, round(sum(value * share) / sum(share), 3) AS value, round(sum(share), 3) AS weight, count(*) AS n FROM c WHERE share > 0 GROUP BY row, col""")
def quadrilateral_regrid(spark, d):
    x, y, s = (F.col("l_partkey") % 50) + 0.25, (F.col("l_suppkey") % 20) + 0.5, (F.col("l_linenumber") % 3) * 0.5 + 0.5
    quads = table(spark, d, "lineitem").select(F.col("l_quantity").alias("value"), x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), y.alias("y2"), (x + s).alias("x3"), (y + s).alias("y3"), x.alias("x4"), (y + s).alias("y4"))
    # sums of ninths come in any order: what is a tie but for their last bits is rounded as one
    return R.regrid_quads(quads, G.Grid(60, 25, 0.0, 0.0, 1.0, 1.0), []).select("row", "col", F.round(F.round("value", 9), 3).alias("value"), F.round("weight", 3).alias("weight"), "n")


@query(f"""WITH {POINTS_SQL}, c AS (SELECT DISTINCT (station % 12)::INTEGER AS row, (station // 12)::INTEGER AS col, lon, lat FROM points)
SELECT a.row, a.col, round((a.lon + b.lon + c.lon + e.lon) / 4, 6) AS corner_lon, round((a.lat + b.lat + c.lat + e.lat) / 4, 6) AS corner_lat
FROM c a JOIN c b ON b.row = a.row + 1 AND b.col = a.col JOIN c ON c.row = a.row AND c.col = a.col + 1 JOIN c e ON e.row = a.row + 1 AND e.col = a.col + 1""")
def cell_corners(spark, d):
    centres = points(spark, d).select((F.col("station") % 12).cast("int").alias("row"), F.floor(F.col("station") / 12).cast("int").alias("col"), "lon", "lat").distinct()
    return R.corners(centres, []).select("row", "col", r6(F.col("corner_lon"), "corner_lon"), r6(F.col("corner_lat"), "corner_lat"))


@query("""SELECT l_suppkey, ((l_orderkey % 64) // 8)::INTEGER AS point, ((l_linenumber - 1) * 3 // 7)::INTEGER AS level, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY ALL""")
def profile_windows(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 64).alias("point"), (F.col("l_linenumber") - 1).alias("level"), F.col("l_quantity").alias("value"))
    return R.by_window(p, 8, 7, 3, ["l_suppkey"]).select("l_suppkey", "point", "level", r6(F.col("value"), "value"), "n")


@query("SELECT event_id, layer FROM (SELECT event_id, CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 40 THEN 1 WHEN value >= 40 AND value < 100 THEN 2 END AS layer FROM points)")
def layer_assignment(spark, d):
    return points(spark, d).select("event_id", G.layer_of(F.col("value"), [0.0, 10.0, 40.0, 100.0]).alias("layer"))


# --- projections -----------------------------------------------------------

_PLACES = "SELECT DISTINCT station, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points"
for _name, _projection in {
    "lambert": Lambert(6378137.0, 6356752.314245179, -97.0, 40.0, 33.0, 45.0),
    "mercator": Mercator(6378137.0, 6356752.314245179, -97.0),
    "albers": Albers(6378137.0, 6356752.314245179, -96.0, 23.0, 29.5, 45.5),
    "stereographic": Stereographic(6378137.0, 6356752.314245179, -98.0, 90.0, 45.0),
}.items():

    @query(_PLACES, f"roundtrip_{_name}")
    def _roundtrip(spark, d, p=_projection):
        lon, lat = p.unproject(*p.project(F.col("lon"), F.col("lat")))
        return points(spark, d).select("station", "lon", "lat").distinct().select("station", r6(lon, "lon"), r6(lat, "lat"))


@query("""SELECT DISTINCT station, round(6370997.0::DOUBLE * radians(lon + 97), 3) AS x, round(6370997.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM points""")
def project_mercator(spark, d):
    x, y = Mercator(centre_lon=-97.0).project(F.col("lon"), F.col("lat"))
    return points(spark, d).select("station", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")).distinct()


# --- aggregation over time -------------------------------------------------


@query(f"SELECT station, {_HOUR_SQL} AS hour, round(avg(value), 6) AS value, count(*) AS n FROM points GROUP BY ALL")
def hourly_mean_count(spark, d):
    return points(spark, d).groupBy("station", hour()).agg(r6(F.avg("value"), "value"), F.count("*").alias("n"))


def _daily(how):
    def run(spark, d):
        return points(spark, d).groupBy("variable", day()).agg(r6(how("value"), "value"))

    return run


for _name, _f in (("mean", F.avg), ("max", F.max)):
    query(f"SELECT variable, {_DAY_SQL} AS day, round({'avg' if _name == 'mean' else 'max'}(value), 6) AS value FROM points GROUP BY ALL", f"daily_{_name}")(_daily(_f))


@query(f"""WITH {POINTS_SQL}, h AS (SELECT variable, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS hour, avg(value) AS value FROM points GROUP BY ALL),
m AS (SELECT variable, hour, CASE WHEN count(value) OVER w >= 6 THEN avg(value) OVER w END AS m FROM h WINDOW w AS (PARTITION BY variable ORDER BY hour RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT variable, hour // 24 AS day, round(max(m), 6) AS value FROM m GROUP BY ALL HAVING max(m) IS NOT NULL""")
def daily_max8(spark, d):
    h = points(spark, d).groupBy("variable", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour")).agg(F.avg("value").alias("value"))
    return R.daily_max8(h, ["variable"]).select("variable", "day", r6(F.col("value"), "value"))


@query("SELECT l_suppkey, strftime(l_shipdate, '%Y%m')::BIGINT AS month, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def monthly_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", T.pack(F.col("l_shipdate"), "yyyyMM").alias("month")).agg(r6(F.avg("l_quantity"), "value"), F.count("*").alias("n"))


@query("""SELECT season, round(avg(l_quantity), 6) AS value, count(*) AS n FROM (SELECT l_quantity, l_shipdate + INTERVAL 1 MONTH AS m FROM lineitem) s,
LATERAL (SELECT year(m)::VARCHAR || CASE quarter(m) WHEN 1 THEN 'DJF' WHEN 2 THEN 'MAM' WHEN 3 THEN 'JJA' ELSE 'SON' END AS season) GROUP BY season""")
def seasonal_mean(spark, d):
    return table(spark, d, "lineitem").groupBy(T.season(F.col("l_shipdate")).alias("season")).agg(r6(F.avg("l_quantity"), "value"), F.count("*").alias("n"))


@query("SELECT variable, coalesce(round(avg(value), 6), -9999) AS value FROM points WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45 AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY AND ts < '2024-01-20' GROUP BY variable")
def box_mean_14d(spark, d):
    end = F.lit("2024-01-20").cast("timestamp")
    p = points(spark, d).filter(FL.in_box(F.col("lon"), F.col("lat"), BOX) & (F.col("ts") >= end - F.expr("INTERVAL 14 DAYS")) & (F.col("ts") < end))
    return p.groupBy("variable").agg(F.coalesce(F.round(F.avg("value"), 6), F.lit(-9999.0)).alias("value"))


@query("SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n FROM points")
def point_bounds(spark, d):
    return points(spark, d).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count("*").alias("n"))


@query(f"SELECT {_HOUR_SQL} AS hour, count(*) AS points, count(*) FILTER (value > 50) AS high FROM points GROUP BY 1")
def points_per_hour(spark, d):
    return points(spark, d).groupBy(hour()).agg(F.count("*").alias("points"), F.count_if(F.col("value") > 50).alias("high"))


@query("""SELECT o_custkey, "left"(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), 40) AS notes FROM orders GROUP BY o_custkey""")
def note_concat(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(R.notes(F.col("o_orderpriority"), 40).alias("notes"))


@query("""WITH c AS (SELECT station, count(*) AS n FROM points GROUP BY station) SELECT station, n, sum(n) OVER (ORDER BY station)::BIGINT AS total FROM c""".replace("WITH c", f"WITH {POINTS_SQL}, c"))
def running_total(spark, d):
    c = points(spark, d).groupBy("station").agg(F.count("*").alias("n"))  # one row a station
    return R.running_total(c, "station", "n", 1000)


@query("""SELECT o_custkey, arg_max(p, (n, p)) AS version FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def mode_version(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.max_by("p", F.struct("n", "p")).alias("version"))


@query(f"""SELECT event_id, variable, hour FROM (SELECT event_id, variable, {_HOUR_SQL} AS hour, rank() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY variable DESC) AS r FROM points) WHERE r = 1""")
def latest_version_per_ts(spark, d):
    p = points(spark, d).select("event_id", "variable", hour())
    return p.withColumn("r", F.rank().over(W.partitionBy("hour").orderBy(F.desc("variable")))).filter("r = 1").drop("r")


@query("""SELECT p_brand, list_max(list(p_retailprice)) AS most, round(list_avg(list(p_retailprice)), 6) AS mean, (list(p_retailprice ORDER BY p_partkey))[1] AS first FROM part GROUP BY p_brand""")
def vector_reducers(spark, d):
    v = F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice")))
    g = table(spark, d, "part").groupBy("p_brand").agg(F.transform(v, lambda s: s["p_retailprice"]).alias("v"))
    return g.select("p_brand", F.array_max("v").alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 6).alias("mean"), F.element_at("v", 1).alias("first"))


# --- joins -----------------------------------------------------------------


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, date_trunc('hour', ts) AS h FROM points)
SELECT {_HOUR_SQL.replace('ts', 'h')} AS hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY abs(lon + 95) + abs(lat - 36), event_id) AS k FROM p) WHERE k = 1""")
def nearest_per_hour(spark, d):
    p = points(spark, d).withColumn("hour", hour())
    return J.nearest_per(p, ["hour"], G.manhattan(F.col("lon"), F.col("lat"), F.lit(-95.0), F.lit(36.0)), ["event_id"]).select("hour", "event_id", "value")


_STATIONS = "(SELECT s_suppkey, DATE '1990-01-01' + (s_suppkey % 2000)::INTEGER AS a, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1990-01-01' + (s_suppkey % 2000 + 900)::INTEGER END AS b FROM supplier)"


@query(f"SELECT s_suppkey FROM {_STATIONS} WHERE a <= DATE '1990-04-30' AND (b IS NULL OR b >= DATE '1990-01-20')")
def interval_overlap_stations(spark, d):
    a = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("s_suppkey") % 2000).cast("int"))
    b = F.when(F.col("s_suppkey") % 7 != 0, F.date_add(a, 900))
    return table(spark, d, "supplier").filter(J.intervals_overlap(a, b, F.lit("1990-01-20").cast("date"), F.lit("1990-04-30").cast("date"))).select("s_suppkey")


@query("""WITH a AS (SELECT s_suppkey, s_suppkey * 13 % 5000 AS lo, s_suppkey * 13 % 5000 + s_suppkey % 40 AS hi FROM supplier),
b AS (SELECT p_partkey, p_partkey * 7 % 5000 AS "start", p_partkey * 7 % 5000 + p_size AS "end" FROM part)
SELECT s_suppkey, p_partkey FROM a, b WHERE lo <= "end" AND hi >= "start" """)
def interval_overlap_join(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 13 % 5000).alias("lo")).withColumn("hi", F.col("lo") + F.col("s_suppkey") % 40)
    b = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 5000).alias("start"), "p_size").withColumn("end", F.col("start") + F.col("p_size"))
    return J.overlapping(a, b, 64).select("s_suppkey", "p_partkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, (o_custkey * 7 % 360)::DOUBLE - 180 AS w, (o_orderkey * 11 % 160)::DOUBLE - 80 AS s FROM orders)
WHERE w <= -80 AND w + 5 >= -110 AND s <= 45 AND s + 3 >= 28""")
def granule_prune(spark, d):
    w, s = (F.col("o_custkey") * 7 % 360).cast("double") - 180, (F.col("o_orderkey") * 11 % 160).cast("double") - 80
    box = dict(zip(("west", "south", "east", "north"), map(F.lit, BOX)))
    return table(spark, d, "orders").filter(G.boxes_overlap({"west": w, "south": s, "east": w + 5, "north": s + 3}, box)).select("o_orderkey")


@query(f"""WITH {POINTS_SQL}, a AS (SELECT station, {_DAY_SQL} AS day, avg(value) AS v FROM points WHERE variable = 'click' GROUP BY ALL), b AS (SELECT station, {_DAY_SQL} AS day, avg(value) AS v FROM points WHERE variable = 'view' GROUP BY ALL)
SELECT station, day, round(a.v, 6) AS model, round(b.v, 6) AS observed, round(CASE WHEN b.v <> 0 THEN (a.v - b.v) / b.v * 100 END, 4) AS compared FROM a JOIN b USING (station, day)""")
def compare_model_obs(spark, d):
    side = lambda v: points(spark, d).filter(F.col("variable") == v).groupBy("station", day()).agg(F.avg("value").alias("value"))
    out = J.with_compare(side("click"), side("view"), ["station", "day"], "percent_difference")
    return out.select("station", "day", r6(F.col("model"), "model"), r6(F.col("observed"), "observed"), F.round("compared", 4).alias("compared"))


@query(f"""WITH {POINTS_SQL}, n AS (SELECT station, date_trunc('day', ts) AS day, count(*) AS n FROM points GROUP BY ALL)
SELECT s.station, strftime(c.day, '%Y%m%d')::BIGINT AS day, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT station FROM points) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day) c LEFT JOIN n ON n.station = s.station AND n.day = c.day""")
def calendar_fill(spark, d):
    p = points(spark, d)
    n = p.groupBy("station", F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("n"))
    out = J.on_calendar(n, p.select("station").distinct(), "ts", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    return out.select("station", day(), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT s_suppkey, strftime(c, '%Y%m%d')::BIGINT AS chunk_start, strftime(least(c + INTERVAL 30 DAY, TIMESTAMP '2024-03-15'), '%Y%m%d')::BIGINT AS chunk_end
FROM supplier, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-15', INTERVAL 31 DAY)) AS c)""")
def station_requests(spark, d):
    out = J.request_chunks(table(spark, d, "supplier").select("s_suppkey"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-03-15").cast("timestamp"))
    return out.select("s_suppkey", T.pack(F.col("chunk_start"), "yyyyMMdd").alias("chunk_start"), T.pack(F.col("chunk_end"), "yyyyMMdd").alias("chunk_end"))


@query(f"""WITH {POINTS_SQL} SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM points WHERE variable = 'click') a
ASOF LEFT JOIN (SELECT station, ts, max(value) AS value FROM points WHERE variable = 'view' GROUP BY ALL) b ON a.station = b.station AND a.ts >= b.ts""")
def as_of_join(spark, d):
    p = points(spark, d)
    right = p.filter("variable = 'view'").groupBy("station", "ts").agg(F.max("value").alias("value"))
    return J.as_of(p.filter("variable = 'click'").select("event_id", "station", "ts"), right, ["station"], "ts", "value").select("event_id", "asof_value")


@query("""SELECT event_id, CASE WHEN lon > -115 AND lon < -105 AND lat > 30 AND lat < 40 THEN 1 ELSE 2 END AS id FROM points
WHERE lon > -115 AND lon < -105 AND lat > 30 AND lat < 40 OR lon > -100 AND lon < -70 AND lat > 26.005 AND lat - 26.005 < (lon + 100.0) * 0.5""")
def point_in_polygon(spark, d):
    shapes = spark.createDataFrame([(1, [-115.0, -105.0, -105.0, -115.0], [30.0, 30.0, 40.0, 40.0]), (2, [-100.0, -70.0, -70.0], [26.005, 26.005, 41.005])], "id int, xs array<double>, ys array<double>")
    return J.in_polygons(points(spark, d).select("event_id", (F.col("lon")).alias("lon"), "lat"), shapes).select("event_id", "id")


@query(f"""WITH {POINTS_SQL}, s AS (SELECT s_suppkey AS fid, -125 + (s_suppkey * 613 % 6000)::DOUBLE / 100 AS flon, 25 + (s_suppkey * 389 % 2500)::DOUBLE / 100 AS flat FROM supplier),
p AS (SELECT DISTINCT station, lon, lat FROM points), j AS (SELECT station, fid, sqrt(pow(lon - flon, 2) + pow(lat - flat, 2)) AS d FROM p, s)
SELECT station, fid, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY d, fid) AS k FROM j WHERE d <= 3) WHERE k = 1""")
def nearest_feature(spark, d):
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fid"), ((F.col("s_suppkey") * 613 % 6000) / 100.0 - 125.0).alias("flon"), ((F.col("s_suppkey") * 389 % 2500) / 100.0 + 25.0).alias("flat"))
    return J.nearest_feature(points(spark, d).select("station", "lon", "lat").distinct(), f, 3.0).select("station", "fid", r6(F.col("distance"), "distance"))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT (x % 1440)::INTEGER AS i, (x // 1440)::INTEGER AS j, (x * 31 % 4000)::DOUBLE AS elevation FROM range(1440 * 720) t(x) WHERE x % 3 <> 0)
SELECT event_id, elevation FROM points LEFT JOIN r ON i = floor((lon + 180) / 0.25)::INTEGER AND j = floor((lat + 90) / 0.25)::INTEGER""")
def elevation_lookup(spark, d):
    x = F.col("id")
    raster = spark.range(1440 * 720).filter("id % 3 <> 0").select((x % 1440).cast("int").alias("i"), F.floor(x / 1440).cast("int").alias("j"), (x * 31 % 4000).cast("double").alias("elevation"))
    return J.elevation_at(points(spark, d), raster, 0.25).select("event_id", "elevation")


# --- windows ---------------------------------------------------------------


@query("""SELECT event_id, last_value(CASE WHEN value BETWEEN 5 AND 60 THEN value END IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM points""")
def forward_fill(spark, d):
    return R.forward_fill(points(spark, d), F.col("value").between(5, 60), "value", ["station"], ["ts", "event_id"]).select("event_id", "value")


@query("""SELECT station, event_id, variable FROM (SELECT *, lag(variable) OVER w AS b, row_number() OVER w AS k FROM points WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)) WHERE k = 1 OR variable IS DISTINCT FROM b""")
def first_of_run(spark, d):
    return R.first_of_run(points(spark, d), "variable", ["station"], ["ts", "event_id"]).select("station", "event_id", "variable")


# --- functions -------------------------------------------------------------


@query("""SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_retailprice * (5.0::DOUBLE / 9) - 160.0::DOUBLE / 9 WHEN 1 THEN -abs(p_retailprice * 0.3048::DOUBLE) WHEN 2 THEN p_retailprice * 0.028316846592::DOUBLE ELSE p_retailprice END, 6) AS value,
  CASE p_size % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'm' WHEN 2 THEN 'm3/s' ELSE 'furlong' END AS unit FROM part""")
def unit_convert(spark, d):
    u = F.element_at(F.array(*map(F.lit, ("Deg F", " ft ", "CFS", "furlong"))), F.col("p_size") % 4 + 1)
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value"), u.alias("unit"))
    return U.convert(p, depth=True).select("p_partkey", r6(F.col("value"), "value"), "unit")


@query("""SELECT o_orderkey, strftime(o_orderdate + to_hours(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 0 ELSE 0 END), '%Y%m%d%H')::BIGINT AS named,
  strftime(o_orderdate + to_hours(-((o_orderkey % 9)::INTEGER - 4)), '%Y%m%d%H')::BIGINT AS offset_utc FROM orders""")
def timezone_to_utc(spark, d):
    zone = F.element_at(F.array(*map(F.lit, ("EST", "pst", "UTC", "XYZ"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    ts = F.col("o_orderdate").cast("timestamp")
    ahead = (F.col("o_orderkey") % 9 - 4).cast("int")
    return table(spark, d, "orders").select("o_orderkey", T.pack(T.zone_to_utc(ts, zone)).alias("named"), T.pack(T.to_utc(ts, ahead)).alias("offset_utc"))


@query("SELECT o_orderkey, strftime(make_timestamp((725846394 + floor(o_totalprice * 100 + 0.5)::BIGINT) * 1000000), '%Y%m%d%H%M%S')::BIGINT AS stamp FROM orders")
def tai93_decode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.pack(T.tai93(F.col("o_totalprice") * 100), "yyyyMMddHHmmss").alias("stamp"))


@query("""SELECT event_id, strftime(ts, '%Y%j%H%M')::BIGINT AS doy, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S-0000') AS iso,
  ({hours} - strftime(ts, '%H')::INTEGER)::BIGINT AS hours_left, extract(day FROM last_day(ts))::INTEGER AS month_days FROM points""".replace("{hours}", "24"))
def packed_timestamp(spark, d):
    ts, h = F.col("ts"), F.date_trunc("hour", "ts")
    back = T.unpack(T.pack(h))
    end = T.end_of(ts, "day")
    return points(spark, d).select("event_id", T.pack(ts, "yyyyDDDHHmm").alias("doy"), T.iso(back).alias("iso"), T.hours_in(ts, end).alias("hours_left"), T.days_in_month(ts).alias("month_days"))


@query("""SELECT c_custkey, translate(upper(c_name), 'CUSTOMER#', '') AS digits, ('32119201513518' || "right"(c_name, 9))[1:18]::BIGINT AS site, replace(c_mktsegment, '_', ' ') AS segment FROM customer""")
def station_id_numeric(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.translate(F.upper("c_name"), "CUSTOMER#", "").alias("digits"), X.numeric_id(F.col("c_name")).alias("site"), F.translate("c_mktsegment", "_", " ").alias("segment"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT station, hour(ts)::INTEGER AS h, round(sum(value), 6) AS value FROM points WHERE value IS NOT NULL GROUP BY ALL")
def unpivot_hours(spark, d):
    """Hour columns of each station as rows."""
    return unpivot_all_hours(spark, d)


@query("SELECT station, hour(ts)::INTEGER AS h, round(sum(value), 6) AS value FROM points GROUP BY ALL HAVING sum(value) IS NOT NULL")
def unpivot_all_hours(spark, d):
    """A column for each of the day's hours, unpivoted again."""
    names = [f"v{h}" for h in range(24)]
    wide = points(spark, d).groupBy("station").agg(*[F.sum(F.when(F.hour("ts") == h, F.col("value"))).alias(name) for h, name in enumerate(names)])
    long = wide.unpivot("station", names, "name", "value").filter("value is not null")
    return long.select("station", F.substring("name", 2, 2).cast("int").alias("h"), r6(F.col("value"), "value"))


@query("""SELECT station, string_agg(printf('%d=%.2f', h, v), ';' ORDER BY h) AS line FROM (SELECT station, hour(ts)::INTEGER AS h, max(value) AS v FROM points GROUP BY ALL) GROUP BY station""")
def pivot_hours(spark, d):
    h = points(spark, d).groupBy("station", F.hour("ts").alias("h")).agg(F.max("value").alias("v"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: F.format_string("%d=%.2f", s["h"], s["v"]))
    return h.groupBy("station").agg(F.array_join(line, ";").alias("line"))


@query("SELECT DISTINCT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def file_union_distinct(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").unionByName(o.filter("o_orderkey % 3 = 0")).select("o_custkey").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_operations(spark, d):
    c = table(spark, d, "customer")
    idle = c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return idle.intersect(c.filter("c_acctbal > 0").select("c_custkey"))


@query("""SELECT s_suppkey, round(area, 6) AS area FROM (SELECT s_suppkey, ((s_suppkey % 9) + 1)::DOUBLE * ((s_suppkey % 5) + 2)::DOUBLE / 2 AS area FROM supplier)""")
def polygon_area(spark, d):
    a, b = (F.col("s_suppkey") % 9 + 1).cast("double"), (F.col("s_suppkey") % 5 + 2).cast("double")
    return table(spark, d, "supplier").select("s_suppkey", r6(G.ring_area(F.array(F.lit(0.0), a, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), b)), "area"))


@query(f"""WITH {POINTS_SQL}, {_CELLS} SELECT row, col, round(avg(value), 6) AS value, sum(n)::BIGINT AS n FROM (SELECT date_trunc('hour', ts) AS ts, row, col, avg(value) AS value, count(*) AS n FROM cells
WHERE lon BETWEEN -110 AND -80 AND lat BETWEEN 28 AND 45 AND ts BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL) GROUP BY ALL""")
def coverage(spark, d):
    """The flagship: points in a box and period, hourly means on a grid, then the mean of those."""
    p = points(spark, d)
    times = FL.in_time(F.col("ts"), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    p = p.filter(FL.in_box(F.col("lon"), F.col("lat"), BOX) & times).withColumn("ts", F.date_trunc("hour", "ts"))
    return R.reaggregate(R.regrid(p, ONE_DEGREE, "mean", ["ts"]), "ts", "all").select("row", "col", r6(F.col("value"), "value"), "n")
