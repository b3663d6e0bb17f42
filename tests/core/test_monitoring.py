from pyspark.sql import functions as F

from geoflume.functions import text as X
from geoflume.functions.projection import NAMED_ELLIPSOIDS, ellipsoid
from geoflume.sources import monitoring as M
from geoflume.sources import text_sinks as K


def wide(**cells):
    base = {0: "A1", 2: "2012", 6: "A1_1_BOTTOM", 7: "2010", 8: "7/4/2010", 9: "185", 10: "30.5", 11: "-88.25", 13: "Gulf", 15: "6", 22: "1.5", 23: "0.2", 24: "0.1", 27: "3", 36: "a", 37: "b"} | {int(k[1:]): v for k, v in cells.items()}
    return ",".join(base.get(k, "") for k in range(44))


def test_wide_rules(spark, tmp_path):
    lines = ["SITE" + ",x" * 43, wide(), wide(c6="A1_1_SURFACE"), wide(c6="A1_2_MID-WATER", c22="0"), wide(c22="-1"), wide(c22=""), wide(c13=""), wide(c8="7-4-2010"), wide(c15="-2"), wide(c10="north"), "A1,short", wide(c0="A1~b2") + "\r"]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    got = sorted((r.site, r.station, str(r.day), r.yearday, r.depth, r.value, r.note) for r in M.survey_wide(spark, str(tmp_path), "chlorophyll_a").collect())
    assert [g[4] for g in got] == [-6.0, -3.0, -0.1, -6.0] or sorted(g[4] for g in got) == [-6.0, -6.0, -3.0, -0.1]
    assert {g[2] for g in got} == {"2010-07-04"} and {g[3] for g in got} == {2010185} and {int(g[1]) for g in got} == {11, 1122}
    assert M.survey_wide(spark, str(tmp_path), "chlorophyll_a", "surface").count() == 1
    [note] = {r.note for r in M.survey_wide(spark, str(tmp_path), "di_nitrogen_phosphorus_ratio", "mid-water").collect()}
    assert note == "A1 A1_2_MID-WATER Gulf Pub:2012 a b"
    assert sorted(r.site for r in M.survey_sites(spark, str(tmp_path)).collect()) == ["A1", "A1~b2"]


def test_long_rules(spark, tmp_path):
    row = lambda **c: ",".join(({0: "S1", 1: "2015-07-14", 2: "1", 3: "77", 4: "E", 5: "-88", 6: "30", 7: "2.5", 8: "CHLA", 9: "4", 10: "u", 11: "1", 12: "2", 13: "m", 14: "f"} | {int(k[1:]): v for k, v in c.items()})[k] for k in range(15))
    (tmp_path / "l.csv").write_text("\n".join(["a" + ",b" * 14, row(), row(c7="-2.5"), row(c8="DIN"), row(c9="-1"), row(c14=""), row(c1="never")]) + "\n")
    got = [(r.station, str(r.day), r.depth, r.value, r.note) for r in M.survey_long(spark, str(tmp_path), "chlorophyll_a").collect()]
    assert got == [(77, "2015-07-14", -2.5, 4.0, "S1;77;ESTCODE:E;lrl:1;mdl:2;flag:f;method:m")] * 2


def test_sites_flights_and_zones(spark, tmp_path):
    (tmp_path / "sites").write_text("1 -80.5 40.0 one\n2 -70 40 two\nhead lon lat name\n3 -81 41 three more\n")
    assert sorted((r.id, r.note) for r in M.sites(spark, str(tmp_path / "sites"), -82, 39, -80, 42).collect()) == [(1, "one"), (3, "three")]
    (tmp_path / "f.csv").write_text("Time(UTC), Lat,HSRL Mixing Ratio (ppb),ML(m)\n1, 2.5,-9999,3\n")
    df = M.flights(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["Time(UTC)", "Lat", "NO2(ppb)", "MLH(m)"] and tuple(df.first()) == (1.0, 2.5, None, 3.0)
    (tmp_path / "z.json").write_text('{"device": "d", "parameters": [{"name": "t", "unit": "C", "data": [{"timestamp": "2018-07-01 08:00:00", "value": 1}, {"timestamp": "2018-01-01 08:00:00", "value": 2}, {"timestamp": "x", "value": 3}]}]}')
    assert sorted((r.value, str(r.ts)) for r in M.zoned_series(spark, str(tmp_path / "z.json"), "eastern").collect()) == [(1.0, "2018-07-01 12:00:00"), (2.0, "2018-01-01 13:00:00")]


def test_water_series_of_two_sites(spark, tmp_path):
    series = lambda s, u, v: f'<ns1:timeSeries><ns1:sourceInfo><ns1:siteCode network="NWIS">{s}</ns1:siteCode><ns1:geoLocation><ns1:geogLocation><ns1:latitude>40</ns1:latitude><ns1:longitude>-75</ns1:longitude></ns1:geogLocation></ns1:geoLocation></ns1:sourceInfo><ns1:variable><ns1:unit><ns1:unitCode>{u}</ns1:unitCode></ns1:unit></ns1:variable><ns1:values>{v}</ns1:values></ns1:timeSeries>'
    value = lambda t, x: f'<ns1:value dateTime="{t}">{x}</ns1:value>'
    (tmp_path / "w.xml").write_text('<ns1:r xmlns:ns1="http://x">' + series("01", "deg C", value("2020-01-01T00:00:00", 1.5) + value("2020-01-01T01:00:00", -99999)) + series("02", "m", value("2020-01-01T00:00:00", 2)) + series("", "m", value("2020-01-01T00:00:00", 3)) + "</ns1:r>")
    assert sorted((r.site, r.unit, r.value, r.lon) for r in M.water_series(spark, str(tmp_path)).collect()) == [("01", "deg C", 1.5, -75.0), ("02", "m", 2.0, -75.0)]


def test_masked_polygons_and_ellipsoids(spark):
    df = spark.createDataFrame([(" 1", 5), ("2 ", 6), (None, 7)], "k string, v int")
    assert [r.v for r in M.masked(df, spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()] == [5]
    rings = spark.createDataFrame([("a<b", [([0.0, 4.0, 4.0], [0.0, 0.0, 4.0]), ([1.0, 2.0, 2.0], [0.5, 0.5, 1.0]), ([1.0], [1.0])])], "n string, rings array<struct<xs:array<double>,ys:array<double>>>")
    line = K.kml_polygons(rings, "n", "n").first().line
    assert line.count("outerBoundaryIs") == 2 and line.count("innerBoundaryIs") == 2 and "0.000000,0.000000 4.000000,0.000000 4.000000,4.000000 0.000000,0.000000<" in line and "a&lt;b" in line
    assert len(NAMED_ELLIPSOIDS) > 40 and ellipsoid("WGS84")[0] == ellipsoid("WGS_1984")[0] == 6378137.0 and all(a >= b > 0 for a, b in NAMED_ELLIPSOIDS.values())
    n = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("A-1 b2",), ("--",)], "s string").select(X.site_number(F.col("s")).cast("string")).collect()
    assert [r[0] for r in n] == ["1234567891011122526", "1122", None]
