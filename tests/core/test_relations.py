import datetime as dt

from pyspark.sql import functions as F

from geoflume.operators import relations as Q


def test_subset(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, "a"), (None, "a"), (5, None)], "n int, s string")
    rows = lambda x: sorted(map(str, map(tuple, x.collect())))
    assert rows(Q.subset(df, {"n": (1, 5)})) == ["(1, 'a')", "(5, 'b')", "(5, None)"]
    assert rows(Q.subset(df, {"n": (2, None)}, {"s": ["a"]})) == ["(9, 'a')"]
    assert rows(Q.subset(df, {"n": (None, None)})) == rows(df.filter("n is not null"))
    assert Q.subset(df).count() == 5


def test_ids_ground_and_ranges(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 4.0)], "k int, v double")
    assert [r.v for r in Q.only_ids(df, spark.createDataFrame([(2,), (2,), (None,)], "k int"), "k").collect()] == [3.0]
    got = Q.above_sea(df, spark.createDataFrame([(1, 100.0)], "k int, ground double"), "k", F.col("v")).collect()
    assert {r.v: r.elevation for r in got} == {2.0: 102.0, 3.0: None, 4.0: None}
    assert {tuple(r) for r in Q.ranges(df, ["k", "v"]).collect()} == {("k", 1.0, 2.0, 2), ("v", 2.0, 4.0, 3)}
    assert {tuple(r) for r in Q.ranges(df.limit(0), ["v"]).collect()} == {("v", None, None, 0)}


def test_scaled_mean_is_the_same_in_any_order(spark):
    rows = [(i % 3, 0.1 * i) for i in range(999)] + [(7, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = [{r.k: (r.v, r.n) for r in Q.scaled_mean(x, ["k"], "v", 1e6).collect()} for x in (df.repartition(7), df.coalesce(1))]
    assert got[0] == got[1] and got[0][7] == (None, 0) and abs(got[0][0][0] / 1e6 - 49.8) < 1e-9


def test_axes_pages_and_shuffles(spark):
    cells = spark.createDataFrame([(r, c, r * 10 + c) for r in range(2) for c in range(3)], "row int, col int, v int")
    assert {(r.row, r.col, r.v) for r in Q.flipped(cells, 2).collect()} == {(1 - r, c, r * 10 + c) for r in range(2) for c in range(3)}
    assert {(r.row, r.col, r.v) for r in Q.transposed(cells).collect()} == {(c, r, r * 10 + c) for r in range(2) for c in range(3)}
    pages = Q.paged(cells, ["row"], [F.col("col").desc()], 2).collect()
    assert {(r.row, r.col): r.page for r in pages} == {(r, c): (2 - c) // 2 for r in range(2) for c in range(3)}
    a, b, c = ({r.v: r.place for r in Q.shuffled(x, ["row"], "v", s).collect()} for x, s in ((cells, 1), (cells.repartition(3), 1), (cells, 2)))
    assert a == b and sorted(a.values()) == [1, 1, 2, 2, 3, 3] and sorted(c.values()) == [1, 1, 2, 2, 3, 3]


def test_swaths_in_sequence_and_named(spark):
    px = spark.createDataFrame([("b", r, 0) for r in range(3)] + [("a", r, 0) for r in range(2)] + [("c", 0, 0)], "g string, row int, col int")
    assert {(r.g, r.row): r.scan for r in Q.in_sequence(px, "g", F.col("g")).collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 2, ("b", 1): 3, ("b", 2): 4, ("c", 0): 5}
    at = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(at, 1.0), (at + dt.timedelta(hours=1), 3.0)], "ts timestamp, v double")
    got = {(r.name, str(r.start)): r.value for r in Q.named(v, {"hourly": F.date_trunc("hour", "ts"), "daily": F.date_trunc("day", "ts")}, [], "v").collect()}
    assert got == {("hourly_mean_v", "2024-01-01 00:00:00"): 1.0, ("hourly_mean_v", "2024-01-01 01:00:00"): 3.0, ("daily_mean_v", "2024-01-01 00:00:00"): 2.0}
    files = spark.createDataFrame([("x", "a_2_z"), ("x", "a_1_y"), ("x", "a_2_b"), ("w", "short")], "g string, path string")
    assert [(r.path, r.field, r.place) for r in Q.by_field(files, ["g"], 2).orderBy("g", "place").collect()] == [("short", "", 1), ("a_1_y", "1", 1), ("a_2_b", "2", 2), ("a_2_z", "2", 3)]
