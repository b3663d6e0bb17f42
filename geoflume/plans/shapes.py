"""Queries of places beside lines, polygons in time, and corners of swaths."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflume.operators import joins as J
from geoflume.operators import lines as L
from geoflume.operators import regrid as R
from geoflume.operators import smoke as S
from geoflume.plans.points import POINTS_SQL, points, table
from geoflume.plans.registry import query

_X, _Y = "(-125 + s_suppkey * 613 % 6000 / 100.0::DOUBLE)", "(25 + s_suppkey * 389 % 2500 / 100.0::DOUBLE)"


def rivers(spark, d):
    """A line of three vertices from each supplier, up to eight degrees long."""
    k = F.col("s_suppkey")
    x, y = F.lit(-125) + k * 613 % 6000 / F.lit(100.0), F.lit(25) + k * 389 % 2500 / F.lit(100.0)
    return table(spark, d, "supplier").select(k.alias("fid"), F.array(x, x + k % 5, x + k % 9).alias("xs"), F.array(y, y + k % 3, y - k % 4).alias("ys"))


_RIVERS = f"""river AS (SELECT s_suppkey AS fid, {_X} AS x1, {_Y} AS y1, {_X} + s_suppkey % 5 AS x2, {_Y} + s_suppkey % 3 AS y2 FROM supplier
UNION ALL SELECT s_suppkey, {_X} + s_suppkey % 5, {_Y} + s_suppkey % 3, {_X} + s_suppkey % 9, {_Y} - s_suppkey % 4 FROM supplier)"""


@query(f"""WITH {POINTS_SQL}, {_RIVERS}, place AS (SELECT DISTINCT lon, lat FROM points),
cross_ AS (SELECT lon, lat, fid, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM place, river),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM cross_),
far AS (SELECT lon, lat, fid, sqrt((lon - (x1 + t * dx)) * (lon - (x1 + t * dx)) + (lat - (y1 + t * dy)) * (lat - (y1 + t * dy))) AS d FROM t),
best AS (SELECT lon, lat, round(min(d), 6) AS distance FROM far GROUP BY ALL)
SELECT event_id, distance FROM points JOIN best USING (lon, lat)""")
def nearest_line(spark, d):
    """Every reading with its distance from the nearest of the lines, however far."""
    found = L.nearest_line(points(spark, d).select("event_id", "lon", "lat"), rivers(spark, d), 0.5)
    return found.select("event_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH r AS (SELECT s_suppkey AS fid, [{_X}, {_X} + s_suppkey % 5, {_X} + s_suppkey % 9] AS xs, [{_Y}, {_Y} + s_suppkey % 3, {_Y} - s_suppkey % 4] AS ys FROM supplier),
p AS (SELECT fid, i - 1 AS piece, xs[i] AS x, ys[i] AS y, xs[i + 1] - xs[i] AS dx, ys[i + 1] - ys[i] AS dy FROM r, (VALUES (1), (2)) v(i)),
t AS (SELECT *, greatest(0, least((-110 - x) / nullif(dx, 0), (-85 - x) / nullif(dx, 0)), least((28 - y) / nullif(dy, 0), (45 - y) / nullif(dy, 0))) AS t0,
  least(1, greatest((-110 - x) / nullif(dx, 0), (-85 - x) / nullif(dx, 0)), greatest((28 - y) / nullif(dy, 0), (45 - y) / nullif(dy, 0))) AS t1 FROM p
  WHERE (dx <> 0 OR x BETWEEN -110 AND -85) AND (dy <> 0 OR y BETWEEN 28 AND 45))
SELECT fid, piece::INTEGER AS piece, round(x + t0 * dx, 6) AS x1, round(y + t0 * dy, 6) AS y1, round(x + t1 * dx, 6) AS x2, round(y + t1 * dy, 6) AS y2 FROM t WHERE t0 <= t1""")
def clipped_lines(spark, d):
    out = L.clipped(rivers(spark, d), -110.0, 28.0, -85.0, 45.0)
    return out.select("fid", "piece", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_NAMES = ", ".join("'" + n.replace("'", "''") + "'" for n in S.ECOSYSTEMS)


@query(f"""WITH {POINTS_SQL},
fire AS (SELECT event_id, date_trunc('minute', ts) AS ts, lon, lat, [{_NAMES}][event_id % 80] AS ecosystem FROM points),
smoke AS (
  SELECT s_suppkey AS id, -124.995 + s_suppkey * 613 % 5000 / 100.0::DOUBLE AS x, 25.005 + s_suppkey * 389 % 2000 / 100.0::DOUBLE AS y, 1.0::DOUBLE + s_suppkey % 12 AS w, 1.0::DOUBLE + s_suppkey % 7 AS h,
    TIMESTAMP '2024-01-01' + s_suppkey % 29 * INTERVAL 1 DAY + s_suppkey * 7 % 24 * INTERVAL 1 HOUR AS start,
    TIMESTAMP '2024-01-01' + s_suppkey % 29 * INTERVAL 1 DAY + s_suppkey * 11 % 24 * INTERVAL 1 HOUR + CASE WHEN s_suppkey * 11 % 24 < s_suppkey * 7 % 24 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS "end",
    [5, 16, 27][s_suppkey % 3 + 1] AS density
  FROM supplier
)
SELECT event_id, id, ecosystem, CASE density WHEN 5 THEN 'light' WHEN 16 THEN 'medium' ELSE 'dense' END AS density FROM fire JOIN smoke
ON ts BETWEEN start AND "end" AND lon > x AND lon < x + w AND lat > y AND lat < y + h AND NOT (lon > x + w / 4 AND lon < x + w / 2 AND lat > y + h / 4 AND lat < y + h / 2)""")
def fires_in_smoke(spark, d):
    """Readings as fire points (day of year, hhmm, ecosystem) in smoke that has a hole and lasts for hours."""
    e, k = points(spark, d), F.col("s_suppkey")
    yearday, hhmm = F.date_format("ts", "yyyyDDD").cast("int"), F.date_format("ts", "HHmm").cast("int")
    fires = e.select("event_id", S.fire_time(yearday, hhmm).alias("ts"), "lon", "lat", S.ecosystem(F.col("event_id") % 80).alias("ecosystem"))
    x, y = F.lit(-124.995) + k * 613 % 5000 / F.lit(100.0), F.lit(25.005) + k * 389 % 2000 / F.lit(100.0)
    w, h = F.lit(1.0) + k % 12, F.lit(1.0) + k % 7
    ring = lambda a, b: F.struct(F.array(x + w * a, x + w * b, x + w * b, x + w * a).alias("xs"), F.array(y + h * a, y + h * a, y + h * b, y + h * b).alias("ys"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 29).cast("int"))
    start, end = S.smoke_span(day, k * 7 % 24 * 100, k * 11 % 24 * 100)
    plumes = table(spark, d, "supplier").select(k.alias("id"), start.alias("start"), end.alias("end"), J.named(F.element_at(F.array(F.lit(5), F.lit(16), F.lit(27)), (k % 3 + 1).cast("int")), J.SMOKE).alias("density"), F.array(ring(0.0, 1.0), ring(0.25, 0.5)).alias("rings"))
    return S.in_polygons_during(fires, plumes).select("event_id", "id", "ecosystem", "density")


_CENTRES = """c AS (SELECT event_id // 400 AS granule, event_id % 400 // 40 AS row, event_id % 40 AS col,
  (150 + event_id // 400 * 17 % 90 + event_id % 40 * 0.75::DOUBLE + event_id % 400 // 40 * 0.25::DOUBLE + 180) % 360 - 180 AS lon, -60 + event_id // 400 % 100 + event_id % 400 // 40 * 0.5::DOUBLE - event_id % 40 * 0.125::DOUBLE AS lat FROM events)"""


@query(f"""WITH {_CENTRES}, wide AS (SELECT granule, row, col, lon - (SELECT lon FROM c o WHERE o.granule = c.granule ORDER BY row, col LIMIT 1) AS d, (SELECT lon FROM c o WHERE o.granule = c.granule ORDER BY row, col LIMIT 1) AS o, lat FROM c),
flat AS (SELECT granule, row, col, o + CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS lon, lat FROM wide),
rows_ AS (SELECT * FROM flat
  UNION ALL SELECT a.granule, -1, a.col, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM flat a JOIN flat b ON a.granule = b.granule AND a.col = b.col AND a.row = 0 AND b.row = 1
  UNION ALL SELECT a.granule, 10, a.col, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM flat a JOIN flat b ON a.granule = b.granule AND a.col = b.col AND a.row = 9 AND b.row = 8),
p AS (SELECT * FROM rows_
  UNION ALL SELECT a.granule, a.row, -1, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM rows_ a JOIN rows_ b ON a.granule = b.granule AND a.row = b.row AND a.col = 0 AND b.col = 1
  UNION ALL SELECT a.granule, a.row, 40, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM rows_ a JOIN rows_ b ON a.granule = b.granule AND a.row = b.row AND a.col = 39 AND b.col = 38),
q AS (SELECT granule, (row + i)::INTEGER AS row, (col + j)::INTEGER AS col, avg(lon) AS lon, avg(lat) AS lat FROM p, (VALUES (0), (1)) v(i), (VALUES (0), (1)) w(j) GROUP BY ALL HAVING count(*) = 4)
SELECT granule, row, col, round((lon + 540) % 360 - 180, 6) AS corner_lon, round(lat, 6) AS corner_lat FROM q""")
def swath_corners(spark, d):
    """All 11 by 41 corners of swaths of 10 by 40 centres, some across the date line."""
    k = F.col("event_id")
    g, row, col = F.floor(k / 400), F.floor(k % 400 / 40).cast("int"), (k % 40).cast("int")
    lon = (F.lit(150) + g * 17 % 90 + col * 0.75 + row * 0.25 + 180) % 360 - 180
    centres = table(spark, d, "events").select(g.alias("granule"), row.alias("row"), col.alias("col"), lon.alias("lon"), (F.lit(-60) + g % 100 + row * 0.5 - col * 0.125).alias("lat"))
    out = R.swath_corners(centres, ["granule"], 10, 40)
    return out.select("granule", "row", "col", F.round("corner_lon", 6).alias("corner_lon"), F.round("corner_lat", 6).alias("corner_lat"))
