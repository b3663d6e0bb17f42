"""Queries of the scalar functions: times, bounds, geometry, units and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflume.functions import grid as G
from geoflume.functions import projection as P
from geoflume.functions import text as X
from geoflume.functions import timecodes as T
from geoflume.functions import units as U
from geoflume.plans.points import POINTS_SQL, points, table
from geoflume.plans.registry import query

# --- time ------------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderkey, 1990000000 + o_orderkey % 40 * 1000000 + (o_orderkey % 14) * 10000 + (o_orderkey % 33) * 100 + o_orderkey % 26 AS stamp FROM orders)
SELECT o_orderkey, stamp, coalesce(try_strptime(stamp::VARCHAR, '%Y%m%d%H') IS NOT NULL AND stamp // 1000000 BETWEEN 1995 AND 2020, false) AS ok FROM s""")
def stamp_validators(spark, d):
    k = F.col("o_orderkey")
    stamp = F.lit(1990000000) + k % 40 * 1000000 + k % 14 * 10000 + k % 33 * 100 + k % 26
    return table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"), T.is_stamp(stamp, "yyyyMMddHH", 1995, 2020).alias("ok"))


@query("""SELECT o_orderkey, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d,
  strftime(o_orderdate::TIMESTAMP + to_hours(31), '%Y%m%d%H')::BIGINT AS later, strftime(o_orderdate::TIMESTAMP - to_hours(1), '%Y%m%d%H')::BIGINT AS earlier,
  strftime(o_orderdate::TIMESTAMP - to_days(1), '%Y%m%d')::BIGINT AS day_before FROM orders""")
def stamp_steps(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    month, dom = T.month_day(T.pack(day, "yyyyDDD"))
    hour = T.pack(day)
    return table(spark, d, "orders").select("o_orderkey", month.alias("m"), dom.alias("d"), T.stepped(hour, 31).alias("later"), T.stepped(hour, -1).alias("earlier"), T.stepped(T.pack(day, "yyyyMMdd"), -1, "DAY", "yyyyMMdd").alias("day_before"))


@query("""SELECT o_custkey, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS days FROM orders GROUP BY 1""")
def days_spanned(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select("o_custkey", T.days_in(F.col("a"), F.col("b")).cast("long").alias("days"))


@query("""SELECT event_id, strftime(to_timestamp(event_id * 97.5::DOUBLE) AT TIME ZONE 'UTC', '%Y%m%d%H')::BIGINT AS hour FROM events""")
def dods_hours(spark, d):
    return table(spark, d, "events").select("event_id", T.dods_hour(F.col("event_id") * 97.5).alias("hour"))


@query("""SELECT event_id, round(hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE, 6) AS part,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE, 6) AS since FROM points""")
def fractional_hours(spark, d):
    start = F.lit("2024-01-01").cast("timestamp")
    return points(spark, d).select("event_id", F.round(T.fractional_hour(F.col("ts")), 6).alias("part"), F.round(T.counted(F.col("ts"), start), 6).alias("since"))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y%j') ELSE strftime(o_orderdate, '%Y%m%d') END AS digits, o_orderdate AS t FROM orders)
SELECT o_orderkey, strftime(CASE length(digits) WHEN 4 THEN date_trunc('year', t) WHEN 6 THEN date_trunc('month', t) ELSE t END, '%Y%m%d')::BIGINT AS day FROM f""")
def file_name_times(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    digits = F.when(k == 0, F.date_format(t, "yyyy")).when(k == 1, F.date_format(t, "yyyyMM")).when(k == 2, F.date_format(t, "yyyyDDD")).otherwise(F.date_format(t, "yyyyMMdd"))
    path = F.concat(F.lit("/data/x_y_"), digits, F.lit(".nc"))
    return table(spark, d, "orders").select("o_orderkey", T.pack(T.of_file_name(path), "yyyyMMdd").alias("day"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t FROM orders), s AS (SELECT unnest([0, 1, 2]) AS i)
SELECT o_orderkey, i, strftime(date_trunc('year', t) + to_years(i), '%Y%m%d%H')::BIGINT AS yearly, strftime(date_trunc('month', t) + to_months(i), '%Y%m%d%H')::BIGINT AS monthly,
  strftime(t + to_hours(i * 168), '%Y%m%d%H')::BIGINT AS weekly FROM o, s""")
def time_labels(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders")
    zipped = F.arrays_zip(T.labels(t, 3, 8760).alias("yearly"), T.labels(t, 3, 744).alias("monthly"), T.labels(t, 3, 168).alias("weekly"))
    return o.select("o_orderkey", F.posexplode(zipped).alias("i", "l")).select("o_orderkey", "i", "l.*")


@query("""SELECT o_orderkey, strftime(last_day(o_orderdate::DATE) + INTERVAL 1 DAY - INTERVAL 1 SECOND, '%Y%m%d%H%M%S')::BIGINT AS month_end,
  day(last_day(o_orderdate::DATE))::INTEGER AS days, datediff('hour', o_orderdate::TIMESTAMP, last_day(o_orderdate::DATE)::TIMESTAMP) + 1 AS hours FROM orders""")
def ends_of_periods(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", T.pack(T.end_of(t, "month"), "yyyyMMddHHmmss").alias("month_end"), T.days_in_month(t).alias("days"), T.hours_in(t, F.last_day(t).cast("timestamp")).alias("hours"))


# --- bounds and geometry -----------------------------------------------------

_B_SQL = """b AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey * 37 % 400)::DOUBLE - 200 END AS w, (c_custkey * 53 % 190)::DOUBLE - 95 AS s,
  (c_custkey * 71 % 360)::DOUBLE - 180 AS e, (c_custkey * 29 % 180)::DOUBLE - 90 AS n FROM customer)"""


def _bounds(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(k % 17 != 0, (k * 37 % 400 - 200).cast("double")).alias("w"), (k * 53 % 190 - 95).cast("double").alias("s"), (k * 71 % 360 - 180).cast("double").alias("e"), (k * 29 % 180 - 90).cast("double").alias("n"))


@query(f"""WITH {_B_SQL}, x AS (SELECT *, coalesce(w BETWEEN -180 AND 180 AND e BETWEEN -180 AND 180 AND s BETWEEN -90 AND 90 AND n BETWEEN -90 AND 90, false) AS ok FROM b)
SELECT c_custkey, CASE WHEN ok THEN least(w, e) ELSE -180 END AS west, CASE WHEN ok THEN least(s, n) ELSE -90 END AS south,
  CASE WHEN ok THEN greatest(w, e) ELSE 180 END AS east, CASE WHEN ok THEN greatest(s, n) ELSE 90 END AS north FROM x""")
def ordered_bounds(spark, d):
    return _bounds(spark, d).select("c_custkey", *[c.alias(k) for k, c in G.ordered_bounds(*(F.col(x) for x in "wsen")).items()])


@query(f"""WITH {_B_SQL} SELECT c_custkey, CASE WHEN abs(e - w) > 180 THEN CASE WHEN w < 0 THEN -180 ELSE 180 END ELSE e END AS clamped,
  CASE WHEN e + 180 > 180 THEN e + 180 - 360 ELSE e + 180 END AS signed FROM b""")
def dateline_clamp(spark, d):
    return _bounds(spark, d).select("c_custkey", G.clamped(F.col("e"), F.col("w")).alias("clamped"), P.signed(F.col("e") + 180).alias("signed"))


@query(f"""WITH {_B_SQL} SELECT c_custkey, least(w, e) <= -20 AND greatest(w, e) >= 10 AND least(s, n) <= -10 AND greatest(s, n) >= 5 AS holds,
  coalesce(w BETWEEN -180 AND 180, false) AND s BETWEEN -90 AND 90 AS valid FROM b""")
def bounds_predicates(spark, d):
    w, s, e, n = (F.col(x) for x in "wsen")
    a = {"west": F.when(w.isNotNull(), F.least(w, e)).otherwise(e), "south": F.least(s, n), "east": F.when(w.isNotNull(), F.greatest(w, e)).otherwise(e), "north": F.greatest(s, n)}
    box = dict(zip(("west", "south", "east", "north"), (F.lit(x) for x in (-20.0, -10.0, 10.0, 5.0))))
    return _bounds(spark, d).select("c_custkey", G.subsumes(a, box).alias("holds"), (F.coalesce(G.valid_lon(w), F.lit(False)) & G.valid_lat(s)).alias("valid"))


@query("""SELECT event_id, round(degrees(atan(tan(radians(lat)) * pow(6356752.314245179::DOUBLE / 6378137.0::DOUBLE, 2))), 6) AS sphere, round(lat, 6) AS back FROM points""")
def latitude_spheroid(spark, d):
    on = G.geocentric(F.col("lat"))
    return points(spark, d).select("event_id", F.round(on, 6).alias("sphere"), F.round(G.geodetic(on), 6).alias("back"))


@query(f"""WITH {_B_SQL}, t AS (SELECT *, greatest(0, least(1, ((0 - e) * (3 - e) + (0 - n) * (4 - n)) / nullif((3 - e) * (3 - e) + (4 - n) * (4 - n), 0))) AS t FROM b)
SELECT c_custkey, round(sqrt(pow(0 - e - coalesce(t, 0) * (3 - e), 2) + pow(0 - n - coalesce(t, 0) * (4 - n), 2)), 6) AS distance,
  round(abs(e) + sqrt(e * e + n * n) + abs(n), 6) AS around FROM t""")
def segments_and_rings(spark, d):
    e, n, zero = F.col("e"), F.col("n"), F.lit(0.0)
    return _bounds(spark, d).select("c_custkey", F.round(G.segment_distance(zero, zero, e, n, F.lit(3.0), F.lit(4.0)), 6).alias("distance"), F.round(G.perimeter(F.array(zero, e, e), F.array(zero, zero, n)), 6).alias("around"))


@query("""WITH s AS (SELECT event_id, (event_id % 100)::DOUBLE / 100 AS sigma FROM events), p AS (SELECT event_id, sigma, ln((sigma * (100000.0::DOUBLE - 10000) + 10000) / 100000.0::DOUBLE) AS z FROM s)
SELECT event_id, round(-(z * z * (287.04::DOUBLE * 50 / (2 * 9.81::DOUBLE)) + z * (287.04::DOUBLE * 290 / 9.81::DOUBLE)), 4) AS height, round(sigma, 6) AS back FROM p""")
def sigma_heights(spark, d):
    sigma = (F.col("event_id") % 100) / 100.0
    height = G.sigma_height(sigma, 10000.0)
    return table(spark, d, "events").select("event_id", F.round(height, 4).alias("height"), F.round(G.height_sigma(height, 10000.0), 6).alias("back"))


_R = "6370000.0::DOUBLE"


@query(f"""WITH {POINTS_SQL}, k AS (SELECT (sin(radians(29.5::DOUBLE)) + sin(radians(45.5::DOUBLE))) / 2 AS n, cos(radians(29.5::DOUBLE)) * cos(radians(29.5::DOUBLE)) AS c1, sin(radians(29.5::DOUBLE)) AS s1, sin(radians(23.0::DOUBLE)) AS s0),
r AS (SELECT event_id, n, sqrt(c1 + 2 * n * s1 - 2 * n * sin(radians(lat))) / n AS rho, sqrt(c1 + 2 * n * s1 - 2 * n * s0) / n AS rho0, n * radians(lon + 96) AS theta FROM points, k)
SELECT event_id, round({_R} * rho * sin(theta), 3) AS x, round({_R} * (rho0 - rho * cos(theta)), 3) AS y FROM r""")
def project_albers(spark, d):
    """Forward values on a sphere, by the textbook's formulas in the SQL."""
    x, y = P.Albers(6370000.0, 6370000.0, -96.0, 23.0, 29.5, 45.5).project(F.col("lon"), F.col("lat"))
    return points(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {POINTS_SQL}, a AS (SELECT event_id, radians(90 - lat) AS c, radians(lon + 98) AS theta FROM points),
b AS (SELECT *, {_R} * (1 + sin(radians(60.0::DOUBLE))) * tan(c / 2) AS r FROM a)
SELECT event_id, round(r * sin(theta), 3) AS x, round(-r * cos(theta), 3) AS y FROM b""")
def project_stereographic(spark, d):
    """Forward values of the polar projection on a sphere, true at 60 degrees north."""
    x, y = P.Stereographic(6370000.0, 6370000.0, -98.0, 90.0, 60.0).project(F.col("lon"), F.col("lat"))
    return points(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""SELECT event_id, lon AS x, lat AS y FROM points""")
def project_lonlat(spark, d):
    x, y = P.LonLat().project(F.col("lon"), F.col("lat"))
    return points(spark, d).select("event_id", x.alias("x"), y.alias("y"))


# --- units and text -----------------------------------------------------------


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS a, CASE WHEN event_id % 10 <> 0 THEN event_id % 5 ELSE NULL END::DOUBLE AS b FROM events)
SELECT event_id, round(a + b, 6) AS total, round(a - b, 6) AS difference, round(a * b, 6) AS product, round(a / nullif(b, 0), 6) AS quotient,
  abs(a - b) <= 0.5::DOUBLE * greatest(1, abs(a), abs(b)) AS equal FROM v""")
def nan_safe_math(spark, d):
    e, nan = F.col("event_id"), F.lit(float("nan"))
    v = table(spark, d, "events").select("event_id", F.when(e % 6 != 0, F.col("value")).otherwise(nan).alias("a"), F.when(e % 10 != 0, (e % 5).cast("double")).otherwise(nan).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = F.when(~F.isnan(a) & ~F.isnan(b), U.about_equal(a, b, 0.5))
    four = (("total", U.try_sum), ("difference", U.try_difference), ("product", U.try_product), ("quotient", U.try_quotient))
    return v.select("event_id", *[F.round(f(a, b), 6).alias(n) for n, f in four], both.alias("equal"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN -0.1::DOUBLE WHEN 1 THEN round(-value / 2, 6) ELSE -value END AS depth, CASE WHEN value > 20 THEN -value ELSE value END AS below,
  round(value * 6.022141e19::DOUBLE / 1e15, 4) AS molecules, round(value * 0.01::DOUBLE, 6) AS hpa FROM events""")
def depth_and_scale_rules(spark, d):
    v = F.col("value")
    kind = F.element_at(F.array(F.lit("Surface water"), F.lit("Midwater"), F.lit("Bottom")), (F.col("event_id") % 3 + 1).cast("int"))
    depth = F.when(F.col("event_id") % 3 == 1, F.round(U.depth_of(kind, v), 6)).otherwise(U.depth_of(kind, v))
    below = F.when(v > 20, U.below(v)).otherwise(v)
    molecules, hpa = (U.converted(v, F.lit(u))[0] for u in ("mol/m2", " Pa"))
    return table(spark, d, "events").select("event_id", depth.alias("depth"), below.alias("below"), F.round(molecules / 1e15, 4).alias("molecules"), F.round(hpa, 6).alias("hpa"))


@query("""SELECT p_partkey, list_position(string_split('a,' || p_type || ',c', ','), p_type) - 1 AS place,
  array_to_string(list_transform(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda x: upper(x[1]) || x[2:]), '_') AS capital,
  regexp_replace(p_name || ';|$', '[^A-Za-z0-9_.,:/+\\- ]', '_', 'g') AS cleaned, concat_ws(';', p_brand, p_type) AS described,
  printf('%9.4f', p_retailprice::DOUBLE) AS number, 'x,' || replace(p_type, ' ', '') || 'y' AS plain FROM part""")
def text_helpers(spark, d):
    t = F.col("p_type")
    quoted = F.concat(F.lit('x,"'), F.replace(t, F.lit(" "), F.lit(",")), F.lit('"y'))
    return table(spark, d, "part").select(
        "p_partkey",
        X.word_index(F.concat(F.lit("a,"), t, F.lit(",c")), t).alias("place"),
        X.capitalised(F.lower(F.replace(t, F.lit(" "), F.lit("_")))).alias("capital"),
        X.cleaned(F.concat("p_name", F.lit(";|$"))).alias("cleaned"),
        X.described(F.col("p_brand"), t).alias("described"),
        F.format_string("%9.4f", F.col("p_retailprice").cast("double")).alias("number"),
        X.unquoted(quoted).alias("plain"),
    )
