import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from geoflume.sources import binary as B
from geoflume.sources import tables as S
from geoflume.sources import text_sinks as K
from geoflume.streaming import rollups as R


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('when,Longitude,v,hru1\n"3/7/2019 05:45,-5",-80,1,9\nnever,-80,2,9\n2019-03-07T05:45,-81,,9\n')
    df = S.sensor_csv(spark, str(tmp_path / "a.csv"), "when", True)
    assert df.columns == ["when", "Longitude", "v", "ts"] and [r.ts.hour for r in df.orderBy("ts").collect()] == [5, 10]
    assert S.required_csv(spark, str(tmp_path / "a.csv"), ["v"]).count() == 2
    (tmp_path / "f.txt").write_text("# head\n 12 abc 1.5\n xx def   ?\n")
    assert [tuple(r) for r in S.fixed_width(spark, str(tmp_path / "f.txt"), [("a", 1, 3, "int"), ("b", 5, 3, "string"), ("c", 9, 3, "double")], "^#").collect()] == [(12, "abc", 1.5), (None, "def", None)]
    (tmp_path / "j.json").write_text('{"data_time_stamp": 1700000000, "fields": ["id", "name"],\n "data": [[1, "x, y"], [2, null]]}')
    got = sorted(((r.row["id"], r.row["name"]) for r in S.sensor_json(spark, str(tmp_path / "j.json")).collect()))
    assert got == [("1", "x, y"), ("2", None)]
    (tmp_path / "w.xml").write_text('<s><value dateTime="2020-01-01T00:00:00" q="P">1.5</value><value dateTime="2020-01-01T01:00:00" q="A">2</value></s>')
    assert sorted(r["reading"] for r in S.water_xml(spark, str(tmp_path / "w.xml")).collect()) == [1.5, 2.0]
    wide = spark.createDataFrame([(1, 2020, 60, *[float(h) if h != 3 else -999.0 for h in range(1, 25)])], "site int, year int, day int, " + ", ".join(f"h{i} double" for i in range(1, 25)))
    long = S.wide_hours(wide, "h", ["site"]).orderBy("ts").collect()
    assert len(long) == 23 and long[0].ts == dt.datetime(2020, 2, 29) and long[-1].ts.hour == 23
    assert spark.range(1).select(S.month_name_date(F.lit("JAN-05-2001"))).first()[0] == dt.date(2001, 1, 5)


def test_files(spark, tmp_path):
    for n in ("x_20240101T05_V02.nc", "x_20240101T05_V03.nc", "y_2024061.nc"):
        (tmp_path / n).write_text("lon: -80.5\nrest\n")
    g = S.granules(spark, str(tmp_path))
    assert sorted(r.ts for r in g.collect()) == [dt.datetime(2024, 1, 1, 5)] * 2 + [dt.datetime(2024, 3, 1)]
    v = g.withColumn("version", F.regexp_extract("path", r"_V(\d+)", 1))
    assert S.latest(v, ["ts"], "version").count() == 2
    assert {r.lon for r in S.header_files(spark, str(tmp_path), {"lon": r"^lon: ([-0-9.]+)"}).collect()} == {"-80.5"}


def test_point_streams(spark, tmp_path):
    df = spark.range(50).select(F.lit("note").alias("note"), (F.col("id") + 20240101000000).alias("stamp"), (F.col("id") * -1.5).alias("lon"), F.lit(40.0).alias("lat"), F.lit(0.0).alias("elevation"), "id", (F.col("id") / 7).alias("value"))
    for r in B.point_streams(df.repartition(3, "id"), "pm25", "ug/m3", "2024-01-01T00:00:00-0000").collect():
        (tmp_path / f"{r.part}.xdr").write_bytes(bytes(r.content))
    back = B.read_points(spark, str(tmp_path))
    assert sorted((r.id, r.lon, r.value, r.note) for r in back.collect()) == sorted((float(r.id), r.lon, r.value, "note") for r in df.collect())


def test_grid_file_and_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(5, 0, 1, 2.5), (5, 1, 0, 3.5)], "hour long, row int, col int, value double")
    g = np.frombuffer(bytes(B.grid_file(cells, 2, 3).first().content), ">f4").reshape(2, 3)
    assert g.tolist() == [[3.5, -9999, -9999], [-9999, 2.5, -9999]]
    p = spark.createDataFrame([("a<b", 1.0, -80.0, 40.0)], "name string, value double, lon double, lat double")
    assert "a&lt;b" in K.kml_points(p, "name", "value").first().line and '"coordinates":[-80.0,40.0]' in K.geojson(p, "name").first().line
    K.write_sheet(p, str(tmp_path / "s"), {"value": "ppb"}, compress=True)
    assert spark.read.csv(str(tmp_path / "s"), sep="\t", header=True).columns == ["name(-)", "value(ppb)", "lon(-)", "lat(-)"]
    assert "no2" in K.capabilities(S.catalog(spark, [("airnow", "no2", "ppb", 1.0, 0.0, 1e3, None)])).first().line


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [f'{{"sensor": {s}, "ts": "2024-01-0{d} {h:02}:10:00", "value": {h}}}' for d in (1, 2) for h in range(24) for s in (1, 2)]
    (src / "a.json").write_text("\n".join([*rows, "broken{"]) + "\n")
    stream = R.good(R.sensor_stream(spark, str(src), "sensor long, ts timestamp, value double"))
    for n in range(2):  # a second run with nothing new adds nothing
        R.upsert(R.closed_means(stream, "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"), ["sensor", "start"]).awaitTermination()
        got = sorted((r.sensor, r.start.day, r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(1, 1, 11.5, 24), (2, 1, 11.5, 24)]
    q = R.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.sensor, r.value) for r in spark.table("latest").collect()) == [(1, 23.0), (2, 23.0)]


def test_a_stream_is_decoded_a_piece_at_a_time():
    """No batch holds a whole stream, whose notes alone take some times its bytes."""
    n = 3 * B.ROWS + 5
    data = B.encode({c: np.arange(n) + k for k, c in enumerate(B.COLUMNS)}, [f"n{i}" for i in range(n)], "v", "m", "2024-01-01T00:00:00-0000")
    parts = list(B.decoded(data, B.ROWS))
    assert [len(x) for x, _ in parts] == [B.ROWS] * 3 + [5] and sum((x for x, _ in parts), []) == [f"n{i}" for i in range(n)]
    assert np.array_equal(np.hstack([v for _, v in parts]), B.decode(data)[1]) and len(data) < B.PIECE * 200 and B.PIECE * 128 < 16e6
    empty = B.encode({c: np.zeros(0) for c in B.COLUMNS}, [], "v", "m", "2024-01-01T00:00:00-0000")
    assert B.decode(empty)[0] == [] and B.decode(empty)[1].shape == (6, 0)
