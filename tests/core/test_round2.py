from pyspark.sql import functions as F

from geoflume.functions.grid import Grid
from geoflume.operators import joins as J
from geoflume.operators import regrid as R
from geoflume.sources import binary


def test_quads_by_both_ways(spark):
    """Merging equal quads first gives what clipping every (quad, cell) pair gives; empty tables and quads off the grid too."""
    k = F.col("id")
    x, y = k % 37 / 3.0 - 4, k % 23 / 2.0 - 3
    quads = spark.range(3000).select((k % 4).alias("g"), F.when(k % 11 != 0, (k % 17).cast("double")).alias("value"), x.alias("x1"), y.alias("y1"), (x + 1.7).alias("x2"), (y + 0.3).alias("y2"), (x + 2).alias("x3"), (y + 1.9).alias("y3"), (x - 0.4).alias("x4"), (y + 1.1).alias("y4"))
    grid = Grid(8, 6, 0.0, 0.0, 1.0, 1.0)
    parts = R.quads_to_cells(quads.filter("value is not null"), grid)
    want = parts.groupBy("g", "row", "col").agg(F.round(F.sum(F.col("value") * F.col("share")) / F.sum("share"), 9).alias("value"), F.round(F.sum("share"), 9).alias("weight"), F.count("*").alias("n"))
    got = R.regrid_quads(quads, grid, ["g"]).select("g", "row", "col", F.round("value", 9).alias("value"), F.round("weight", 9).alias("weight"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    assert R.regrid_quads(quads.limit(0), grid, ["g"]).count() == 0


def test_nearest_feature_keeps_repeated_and_far_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 50.0, 0.0)], "id long, lon double, lat double")
    f = spark.createDataFrame([(9, 0.1, 0.0)], "fid long, flon double, flat double")
    assert [r.fid for r in J.nearest_feature(p, f, 1.0).collect()] == [9, 9]
    assert sorted(str(r.fid) for r in J.nearest_feature(p, f, 1.0, "left").collect()) == ["9", "9", "None"]


def test_open_ends_without_any_known(spark):
    a = spark.createDataFrame([(1, None, None), (2, None, None)], "a long, lo long, hi long")
    b = spark.createDataFrame([(3, None, None)], "b long, start long, end long")
    assert sorted((r.a, r.b) for r in J.overlapping(a, b, 10).collect()) == [(1, 3), (2, 3)]


def test_point_streams_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(binary, "PIECE", 40)
    rows = spark.range(100).coalesce(1).select(*[F.col("id").cast("double").alias(c) for c in binary.COLUMNS], F.lit("n").alias("note"))
    parts = binary.point_streams(rows, "v", "m", "2024-01-01T00:00:00-0000").collect()
    total = sum(binary.decode(bytes(r.content))[1].shape[1] for r in parts)
    assert total == 100
