"""Contracts of functions and operators: round trips, invariances and hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoflume.functions import grid as G
from geoflume.functions import text as X
from geoflume.functions import timecodes as T
from geoflume.functions.projection import ELLIPSOIDS, Albers, Lambert, Mercator, Stereographic
from geoflume.operators import filters as FL
from geoflume.operators import joins as J
from geoflume.operators import regrid as R

WGS = ELLIPSOIDS["WGS84"]
PROJECTIONS = [Lambert(*WGS, -97, 40, 33, 45), Lambert(centre_lon=-97, centre_lat=40, lat1=40, lat2=40), Mercator(*WGS, -97), Albers(*WGS, -96, 23, 29.5, 45.5), Albers(centre_lon=10, lat1=30, lat2=30), Stereographic(*WGS, -98, 90, 60), Stereographic(centre_lon=0, secant_lat=90), Stereographic(*WGS, 20, -90, -71)]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("p", PROJECTIONS)
def test_unproject_project(spark, p):
    sign = -1 if getattr(p, "secant_lat", 1) < 0 else 1
    df = spark.range(300).select((F.col("id") % 20 * 4.0 - 130).alias("lon"), (sign * (F.col("id") % 15 * 4.0 + 20)).alias("lat"))
    lon, lat = p.unproject(*p.project(F.col("lon"), F.col("lat")))
    worst = df.select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first()
    assert worst.a < 1e-7 and worst.b < 1e-7


def test_projection_values(spark):
    """Snyder's worked examples (1987, pp. 295 and 291, Clarke 1866)."""
    c = ELLIPSOIDS["clrk66"]
    r = one(spark, *Lambert(*c, -96, 23, 33, 45).project(F.lit(-75.0), F.lit(35.0)), *Albers(*c, -96, 23, 29.5, 45.5).project(F.lit(-75.0), F.lit(35.0)))
    assert [round(x, 1) for x in r] == [1894410.9, 1564649.5, 1885472.7, 1535925.0]
    with pytest.raises(ValueError):
        Lambert(1.0, 2.0)


def test_times(spark):
    ts = F.lit("2024-12-31 17:40:05").cast("timestamp")
    r = one(spark, T.pack(ts, "yyyyDDDHHmm"), T.season(ts), T.iso(ts), T.days_in_month(ts), T.hours_in(ts, ts), T.unpack(F.lit(2023022999)).isNull(), T.unpack(F.lit(2024022923)), T.iso(T.end_of(ts, "month")), T.is_leap(F.lit(2000)), T.is_leap(F.lit(1900)))
    assert list(r) == [20243661740, "2025DJF", "2024-12-31T17:40:05-0000", 31, 1, True, dt.datetime(2024, 2, 29, 23), "2024-12-31T23:59:59-0000", True, False]
    r = one(spark, T.tai93(F.lit(0.2)), T.from_text(F.lit("3/7/2019 05:45,-5")), T.from_text(F.lit("2019-03-07T05:45")), T.from_text(F.lit("none")), T.of_file_name(F.lit("/a/x_2024061.nc")), T.zone_to_utc(F.lit("2024-01-01 22:00:00").cast("timestamp"), F.lit("EST")))
    assert list(r) == [dt.datetime(1992, 12, 31, 23, 59, 54), dt.datetime(2019, 3, 7, 10), dt.datetime(2019, 3, 7, 5), None, dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 2, 3)]


def test_text(spark):
    r = one(spark, X.numeric_id(F.lit("AZ-09x")), X.numeric_id(F.lit("--")), X.capitalised(F.lit("ozone_daily_mean")), X.unquoted(F.lit('a,"b,[c]",d')), X.word_index(F.lit("a, b,c"), "b"), X.word_index(F.lit("a"), "z"), X.cleaned(F.lit("a;b|c")))
    assert list(r) == [1260924, None, "Ozone_Daily_Mean", "a,bc,d", 1, -1, "a_b_c"]


def test_vertical(spark):
    z = G.sigma_height(F.lit(0.5), 5000.0)
    r = one(spark, z, G.height_sigma(z, 5000.0), G.layer_of(F.lit(10.0), [0.0, 10.0, 20.0]), G.layer_of(F.lit(20.0), [0.0, 10.0, 20.0]))
    assert 4000 < r[0] < 6500 and abs(r[1] - 0.5) < 1e-9 and r[2] == 1 and r[3] is None


def test_neutral_thresholds_leave_the_plan(spark):
    v = F.col("v")
    assert FL.at_least_quality(v, F.col("q"), 0) is v and FL.at_most_cloud(v, F.col("c"), 1.0) is v and FL.in_columns(v, F.col("p"), None, None) is v
    with pytest.raises(ValueError):
        FL.in_box(F.lit(0), F.lit(0), (10, 0, -10, 5))
    with pytest.raises(ValueError):
        FL.require_nonempty(spark.range(0))


def test_monotonic(spark):
    df = spark.createDataFrame([(1, 10), (2, 9), (3, 8), (4, 12), (5, 12)], "k int, ts int").withColumn("g", F.lit(1))
    assert sorted(r.k for r in FL.monotonic(df, "k", "ts", ["g"]).collect()) == [1, 3, 4, 5]


def test_quads(spark):
    """Shares of a quad add up to the part of it inside the grid; a diamond is cut evenly."""
    g = G.Grid(4, 4, 0.0, 0.0, 1.0, 1.0)
    rows = [(1, 2.0, 1.0, 3.0, 2.0, 2.0, 3.0, 1.0, 2.0), (2, -1.0, 0.0, 1.0, 0.0, 1.0, 1.0, -1.0, 1.0), (3, 9.0, 9.0, 10.0, 9.0, 10.0, 10.0, 9.0, 10.0)]
    df = spark.createDataFrame(rows, "q int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double")
    got = {}
    for r in R.quads_to_cells(df, g).collect():
        got.setdefault(r.q, []).append(((r.row, r.col), round(r.share, 9)))
    assert sorted(got[1]) == [((1, 1), 0.25), ((1, 2), 0.25), ((2, 1), 0.25), ((2, 2), 0.25)] and got[2] == [((0, 0), 0.5)] and 3 not in got


def test_regrid_is_the_same_over_partitions(spark):
    g = G.Grid(10, 10, 0.0, 0.0, 1.0, 1.0)
    df = spark.range(2000).selectExpr("id", "id * 37 % 1100 / 100.0D as lon", "id * 53 % 1100 / 100.0D as lat", "cast(id % 91 as double) as value")
    for how in ("mean", "nearest", "weighted"):
        a, b = (sorted(tuple(round(x, 9) for x in r) for r in R.regrid(df.repartition(n), g, how, [], order="id").collect()) for n in (1, 17))
        assert a == b and sum(r[3] for r in a) == df.filter("lon < 10 and lat < 10").count()


def test_as_of_and_intervals(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, ts int")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (2, 10, 100)], "k int, ts int, v int")
    assert sorted((r.k, r.ts, r.asof_v) for r in J.as_of(left, right, ["k"], "ts", "v").collect()) == [(1, 1, None), (1, 5, 50), (2, 9, None)]
    a = spark.createDataFrame([(1, 0, 100), (2, 50, 50)], "a int, lo long, hi long")
    b = spark.createDataFrame([(7, 100, 120), (8, 10, 90)], "b int, start long, end long")
    assert sorted((r.a, r.b) for r in J.overlapping(a, b, 16).collect()) == [(1, 7), (1, 8), (2, 8)]
