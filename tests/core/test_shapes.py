import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoflume.functions.grid import Grid
from geoflume.operators import joins as J
from geoflume.operators import lines as L
from geoflume.operators import regrid as R
from geoflume.operators import smoke as S


def to_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = 0 if dx == dy == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def lines(r, n, reach):
    out = []
    for i in range(n):
        x, y = r.uniform(-50, 50), r.uniform(-40, 40)
        k = r.choice([1, 2, 4])
        out.append((i, [x + r.uniform(-reach, reach) * j for j in range(k)], [y + r.uniform(-reach, reach) * j for j in range(k)]))
    return out


@pytest.mark.parametrize("seed, n, reach, cell", [(0, 40, 2.0, 1.0), (1, 15, 30.0, 0.25), (2, 1, 1.0, 0.1)])
def test_nearest_line_against_all_pairs(spark, seed, n, reach, cell):
    r = random.Random(seed)
    rivers = lines(r, n, reach)
    places = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(80)] + [(900, 1.0, 2.0), (901, 1.0, 2.0)]
    got = {x.id: x for x in L.nearest_line(spark.createDataFrame(places, "id long, lon double, lat double"), spark.createDataFrame(rivers, "fid long, xs array<double>, ys array<double>"), cell).collect()}
    assert len(got) == len(places)
    for i, x, y in places:
        d = {f: min(to_segment(x, y, a[k], b[k], a[min(k + 1, len(a) - 1)], b[min(k + 1, len(a) - 1)]) for k in range(max(len(a) - 1, 1))) for f, a, b in rivers}
        best = min(d, key=lambda f: (d[f], f))
        assert got[i].fid == best and math.isclose(got[i].distance, d[best], abs_tol=1e-9)


def test_nearest_line_odd_inputs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id long, lon double, lat double")
    f = spark.createDataFrame([(7, [3.0, 3.0], [4.0, 4.0]), (6, [3.0], [4.0]), (8, [], []), (9, [None], [0.0]), (10, None, None)], "fid long, xs array<double>, ys array<double>")
    assert sorted((r.id, r.fid, r.distance) for r in L.nearest_line(p, f, 1.0).collect()) == [(1, 6, 5.0), (2, None, None)]
    assert sorted((r.id, r.fid) for r in L.nearest_line(p, f.limit(0), 1.0).collect()) == [(1, None), (2, None)]
    assert L.nearest_line(p.limit(0), f, 1.0).count() == 0


def test_clipped(spark):
    r = random.Random(5)
    rivers = [x for x in lines(r, 60, 20.0) if len(x[1]) > 1] + [(900, [-9.0, 9.0], [0.0, 0.0]), (901, [5.0, 5.0], [-90.0, 90.0]), (902, [20.0, 20.0], [0.0, 1.0]), (903, [-5.0, -5.0], [1.0, 1.0])]
    got = {(x.fid, x.piece): (x.x1, x.y1, x.x2, x.y2) for x in L.clipped(spark.createDataFrame(rivers, "fid long, xs array<double>, ys array<double>"), -5.0, -6.0, 5.0, 7.0).collect()}
    assert got[900, 0] == (-5.0, 0.0, 5.0, 0.0) and got[901, 0] == (5.0, -6.0, 5.0, 7.0) and (902, 0) not in got and got[903, 0] == (-5.0, 1.0, -5.0, 1.0)
    for f, xs, ys in rivers:
        for k in range(len(xs) - 1):
            t = np.linspace(0, 1, 4001)
            x, y = xs[k] + t * (xs[k + 1] - xs[k]), ys[k] + t * (ys[k + 1] - ys[k])
            inside = (x >= -5) & (x <= 5) & (y >= -6) & (y <= 7)
            if inside.sum() > 1:
                x1, y1, x2, y2 = got[f, k]
                step = math.hypot(xs[k + 1] - xs[k], ys[k + 1] - ys[k]) / 4000 + 1e-9
                assert math.hypot(x1 - x[inside][0], y1 - y[inside][0]) <= step and math.hypot(x2 - x[inside][-1], y2 - y[inside][-1]) <= step


def inside(x, y, rings):
    n = 0
    for xs, ys in rings:
        for k in range(len(xs)):
            x1, y1, x2, y2 = xs[k], ys[k], xs[(k + 1) % len(xs)], ys[(k + 1) % len(xs)]
            n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def test_in_polygons_during_against_all_pairs(spark):
    r, at = random.Random(2), dt.datetime(2024, 1, 1)
    plumes = []
    for i in range(40):
        rings = []
        x, y, size = r.uniform(-170, 150), r.uniform(-60, 60), 10 ** r.uniform(-1, 2)
        for scale in (1.0, 0.4)[: r.randint(1, 2)]:
            turn = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randint(3, 9)))
            rings.append(([x + size * scale * math.cos(t) for t in turn], [y + size * scale * math.sin(t) for t in turn]))
        start = at + dt.timedelta(minutes=r.randint(0, 9000))
        plumes.append((i, None if i % 9 == 0 else start, None if i % 7 == 0 else start + dt.timedelta(minutes=10 ** r.uniform(0, 3.5)), rings))
    rows = [(i, r.uniform(-180, 180), r.uniform(-90, 90), at + dt.timedelta(minutes=r.randint(0, 10000))) for i in range(1500)]
    schema = "id int, start timestamp, end timestamp, rings array<struct<xs:array<double>,ys:array<double>>>"
    got = S.in_polygons_during(spark.createDataFrame(rows, "k long, lon double, lat double, ts timestamp"), spark.createDataFrame(plumes, schema), 2.0, 30)
    want = sorted((k, i) for k, x, y, t in rows for i, s, e, rings in plumes if (s is None or s <= t) and (e is None or t <= e) and inside(x, y, rings))
    assert sorted((r.k, r.id) for r in got.collect()) == want and len(want) > 50
    empty = spark.createDataFrame([(1, at, at, []), (2, at, at, [([0.0, 1.0], [0.0, 1.0])])], schema)
    assert S.in_polygons_during(spark.createDataFrame(rows, "k long, lon double, lat double, ts timestamp"), empty).count() == 0


def test_fire_codes(spark):
    assert len(S.ECOSYSTEMS) == 73
    df = spark.createDataFrame([(2016291, 1929, 27), (2016366, 5, 1), (2015366, 0, 73), (2016001, 2460, 0), (None, 0, 99)], "day int, time int, code int")
    got = [(str(r.t), r.e) for r in df.select(S.fire_time(F.col("day"), F.col("time")).alias("t"), S.ecosystem(F.col("code")).alias("e")).collect()]
    assert got == [("2016-10-17 19:29:00", "Conifer Forest"), ("2016-12-31 00:05:00", "Urban"), ("None", "Water and Island Fringe"), ("None", None), ("None", None)]
    start, end = S.smoke_span(F.lit("2016-10-17").cast("date"), F.lit(2215), F.lit(115))
    assert [str(x) for x in spark.range(1).select(start, end).first()] == ["2016-10-17 22:15:00", "2016-10-18 01:15:00"]


def padded(a):
    a = np.vstack((2 * a[0] - a[1], a, 2 * a[-1] - a[-2])).T
    a = np.vstack((2 * a[0] - a[1], a, 2 * a[-1] - a[-2])).T
    return (a[1:, 1:] + a[:-1, 1:] + a[1:, :-1] + a[:-1, :-1]) / 4


@pytest.mark.parametrize("rows, cols, west", [(2, 2, 10.0), (3, 2, 179.0), (7, 9, 174.0), (5, 4, -181.0)])
def test_swath_corners_against_padding(spark, rows, cols, west):
    rng = np.random.default_rng(rows)
    lon = west + np.arange(cols) * 0.8 + np.arange(rows)[:, None] * 0.3 + rng.normal(0, 0.05, (rows, cols))
    lat = 10 + np.arange(rows)[:, None] * 0.7 + rng.normal(0, 0.05, (rows, cols))
    wrap = lambda x: (x + 180) % 360 - 180
    data = [("a", r, c, float(wrap(lon[r, c])), float(lat[r, c])) for r in range(rows) for c in range(cols)]
    df = spark.createDataFrame(data, "g string, row int, col int, lon double, lat double")
    for out in (R.swath_corners(df, ["g"]), R.swath_corners(df.drop("g"), []), R.swath_corners(df, ["g"], rows, cols)):
        got = {(r.row, r.col): (r.corner_lon, r.corner_lat) for r in out.collect()}
        assert sorted(got) == [(r, c) for r in range(rows + 1) for c in range(cols + 1)]
        for (r, c), (x, y) in got.items():
            assert abs(wrap(x - padded(lon)[r, c])) < 1e-9 and abs(y - padded(lat)[r, c]) < 1e-9 and -180 <= x < 180
    quads = R.corner_quads(R.swath_corners(df, ["g"]), ["g"]).collect()
    assert len(quads) == rows * cols
    for q in quads:
        xs, ys = [q[f"x{k}"] for k in range(1, 5)], [q[f"y{k}"] for k in range(1, 5)]
        assert max(xs) - min(xs) < 5 and abs(wrap(sum(xs) / 4 - lon[q.row, q.col])) < 0.5 and abs(sum(ys) / 4 - lat[q.row, q.col]) < 0.5


def test_corners_of_holes_and_lines(spark):
    data = [("a", r, c, float(c), float(r)) for r in range(4) for c in range(4) if (r, c) != (3, 3)] + [("b", 0, c, float(c), 0.0) for c in range(5)]
    got = R.swath_corners(spark.createDataFrame(data, "g string, row int, col int, lon double, lat double"), ["g"])
    assert sorted((r.row, r.col) for r in got.collect()) == [(r, c) for r in range(5) for c in range(5) if not (r >= 3 and c >= 3)]


def test_corner_quads_feed_the_regridding(spark):
    data = [(r, c, 1.0 + c, 1.0 + r, float(10 * r + c)) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(data, "row int, col int, lon double, lat double, value double")
    quads = R.corner_quads(R.swath_corners(df, []), []).join(df.select("row", "col", "value"), ["row", "col"]).drop("row", "col")
    got = {(r.row, r.col): r.value for r in R.regrid_quads(quads, Grid(3, 3, 0.5, 0.5, 1.0, 1.0), []).collect()}
    assert len(got) == 9 and sorted(got.values()) == sorted(v for *_, v in data)


def test_points_on_a_boundary_are_outside(spark):
    """On sides, slanting ones too, and on corners; the places are the tables' own, with the rounding of their doubles."""
    u = [21329, 22329, 23329, 1000, 7000, 13500, 22330]
    places = [(k, (k * 37 % 6000) / 100.0 - 125.0, (k * 53 % 2500) / 100.0 + 25.0) for k in u] + [(1, -115.0, 35.0), (2, -110.0, 30.0), (3, -115.0, 30.0), (4, -105.0, 40.0), (5, -110.0, 35.0), (6, -114.99, 30.01)]
    shapes = [(1, [-115.0, -105.0, -105.0, -115.0], [30.0, 30.0, 40.0, 40.0]), (2, [-100.0, -70.0, -70.0], [26.005, 26.005, 41.005])]
    got = J.in_polygons(spark.createDataFrame(places, "k long, lon double, lat double"), spark.createDataFrame(shapes, "id int, xs array<double>, ys array<double>"))
    inside = {k for k, x, y in places if -115 < x < -105 and 30 < y < 40 or -100 < x < -70 and y > 26.005 and y - 26.005 < (x + 100.0) * 0.5}
    assert {r.k for r in got.collect()} == inside and {5, 6} <= inside and not inside & {1, 2, 3, 4, 1000, 21329}


def test_a_place_meets_few_of_many_lines(spark):
    """Long lines are dealt to the cells that they pass, and equal ones are searched once: a place has few to compare, however many there are."""
    k = F.col("id")
    x, y = (k * 613 % 6000) / 100.0, (k * 389 % 2500) / 100.0
    lines = spark.range(4000).select(k.alias("fid"), F.array(x, x + 4).alias("xs"), F.array(y, y + 2).alias("ys"))
    lines = lines.unionByName(lines.withColumn("fid", F.col("fid") + 4000))
    points = spark.range(300).select(k.alias("id"), (k * 37 % 600 / 10.0).alias("lon"), (k * 53 % 250 / 10.0).alias("lat"))
    met = []
    near = J.near_cells
    try:
        J.near_cells = lambda *a: met.append(near(*a).count()) or near(*a)
        got = {r.id: (r.fid, r.distance) for r in L.nearest_line(points, lines, 0.5).collect()}
    finally:
        J.near_cells = near
    assert sum(met) < 300 * 4000 / 20
    seg = [(f, f * 613 % 6000 / 100.0, f * 389 % 2500 / 100.0) for f in range(4000)]
    for i in range(0, 300, 10):
        px, py = i * 37 % 600 / 10.0, i * 53 % 250 / 10.0
        best = min((math.hypot(px - (a + t * 4), py - (b + t * 2)), f) for f, a, b in seg for t in [min(1.0, max(0.0, ((px - a) * 4 + (py - b) * 2) / 20))])
        assert abs(got[i][1] - best[0]) < 1e-9 and got[i][0] < 4000


def test_features_are_found_in_small_cells(spark):
    """A reach of many degrees doesn't bring every feature to every place; features of one place count once."""
    k = F.col("id")
    features = spark.range(20000).select(k.alias("fid"), (k % 100 / 4.0).alias("flon"), (k % 5000 / 100 % 25).alias("flat"))
    points = spark.range(400).select(k.alias("id"), (k * 7 % 250 / 10.0).alias("lon"), (k * 11 % 250 / 10.0).alias("lat"))
    met = []
    near = J.near_cells
    try:
        J.near_cells = lambda *a: met.append(near(*a).count()) or near(*a)
        got = {r.id: (r.fid, r.distance) for r in J.nearest_feature(points, features, 20.0).collect()}
    finally:
        J.near_cells = near
    assert sum(met) < 400 * 200
    seen = {}
    for r in features.collect():
        seen.setdefault((r.flon, r.flat), r.fid)
    for i in range(0, 400, 20):
        px, py = i * 7 % 250 / 10.0, i * 11 % 250 / 10.0
        assert got[i] == min((math.sqrt((px - a) ** 2 + (py - b) ** 2), f) for (a, b), f in seen.items())[::-1]


def test_readings_of_one_place_meet_a_polygon_once(spark, monkeypatch):
    """What a place's readings of one period need of a polygon is decided once; crowded places are cut into several rows, without a loss."""
    monkeypatch.setattr(S, "CHUNK", 100)
    met, blocks = [], S.in_blocks
    monkeypatch.setattr(S, "in_blocks", lambda *a: met.append(blocks(*a).count()) or blocks(*a))
    at = dt.datetime(2024, 1, 1)
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 * 1.0).alias("lon"), F.lit(0.5).alias("lat"), (F.lit(at) + F.make_dt_interval(mins=(F.col("id") % 400).cast("int"))).alias("ts"))
    plumes = spark.createDataFrame([(i, at, at + dt.timedelta(hours=i), [([-0.5, 1.5, 1.5, -0.5], [0.0, 0.0, 1.0, 1.0])]) for i in range(5)], "id int, start timestamp, end timestamp, rings array<struct<xs:array<double>,ys:array<double>>>")
    got = sorted((r.k, r.id) for r in S.in_polygons_during(rows, plumes).collect())
    assert got == [(k, i) for k in range(3000) for i in range(5) if k % 3 < 2 and k % 400 <= i * 60]
    assert met[0] <= 3 * 10 * 5


@pytest.mark.parametrize("held", [1 << 15, 0])
def test_cells_of_lines_and_features_are_never_broadcast(spark, monkeypatch, held):
    """What is dealt to cells has many rows of few bytes: the places are broadcast where they are few, else nothing is, and the nearest are the same."""
    monkeypatch.setattr(J, "HELD_PLACES", held, raising=False)
    plans, near = [], J.near_cells
    monkeypatch.setattr(J, "near_cells", lambda *a: plans.append(near(*a)._jdf.queryExecution().executedPlan().toString()) or near(*a))
    k = F.col("id")
    x, y = (k * 613 % 600) / 10.0, (k * 389 % 250) / 10.0
    points = spark.range(60).select(k.alias("id"), (k * 37 % 600 / 10.0).alias("lon"), (k * 53 % 250 / 10.0).alias("lat"))
    lines = {r.id: (r.fid, r.distance) for r in L.nearest_line(points, spark.range(40).select(k.alias("fid"), F.array(x, x + 1).alias("xs"), F.array(y, y).alias("ys")), 0.5).collect()}
    features = {r.id: (r.fid, r.distance) for r in J.nearest_feature(points, spark.range(40).select(k.alias("fid"), x.alias("flon"), y.alias("flat")), 90.0).collect()}
    at = [(f, f * 613 % 600 / 10.0, f * 389 % 250 / 10.0) for f in range(40)]
    for i in range(60):
        px, py = i * 37 % 600 / 10.0, i * 53 % 250 / 10.0
        best = min((math.hypot(px - min(max(px, a), a + 1), py - b), f) for f, a, b in at)
        assert lines[i][0] == best[1] and abs(lines[i][1] - best[0]) < 1e-9
        assert features[i] == min((math.sqrt((px - a) ** 2 + (py - b) ** 2), f) for f, a, b in at)[::-1]
    assert plans and all("BuildLeft" in p if held else "SortMergeJoin" in p and "Broadcast" not in p for p in plans)
