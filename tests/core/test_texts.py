import gzip
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from geoflume.functions.text import general
from geoflume.sources import numbered as N
from geoflume.sources import tables as S
from geoflume.sources import text_sinks as K


@pytest.mark.parametrize("most", ["128m", "700"])
def test_line_numbers_are_the_files_own(spark, tmp_path, most):
    """Files in one split and in many: empty lines, lines longer than a split, carriage returns, a compressed file."""
    rng, want = random.Random(7), []
    for f in range(5):
        lines = [rng.choice(["", "x", "é" * rng.randint(1, 40), "y" * rng.randint(1, 3000)]) for _ in range(rng.randint(1, 400))]
        data = ("\r\n" if f == 2 else "\n").join(lines + [""]).encode()
        (tmp_path / f"f{f}.txt{'.gz' if f == 4 else ''}").write_bytes(gzip.compress(data) if f == 4 else data)
        want += [(f, i, x) for i, x in enumerate(lines)]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = N.numbered_lines(spark, str(tmp_path))
        if most == "700":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((int(r.file.split("/f")[-1][0]), r.number, r.line) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def coordinate_file(rows, cols, points, head=("hdr_lines: 5", "NX: {c}", "made by hand", "NY: {r}", "x y lat lon")):
    return "\n".join([*(h.format(r=rows, c=cols) for h in head), *(f"{i % cols + 1}\t{i // cols + 1}   {lat} {lon}" for i, (lon, lat) in enumerate(points))]) + "\n"


def test_coordinate_files(spark, tmp_path):
    good = [(-100.0 + i, 30.0 + i / 10) for i in range(12)]
    files = {
        "good": coordinate_file(3, 4, good) + "1 1 0 0\nmore\n",
        "short": coordinate_file(3, 4, good[:11]),
        "off": coordinate_file(3, 4, good[:5] + [(181.0, 0.0)] + good[6:]),
        "unread": coordinate_file(3, 4, good).replace("30.5", "thirty"),
        "headless": "1 1 30 -100\n",
        "no_rows": coordinate_file(0, 4, []),
        "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    got = sorted((r.file.split("/")[-1], r.row, r.col, r.lon, r.lat) for r in N.coordinates(spark, str(tmp_path)).collect())
    assert got == [("good.txt", i // 4, i % 4, lon, lat) for i, (lon, lat) in enumerate(good)]


def rounded_first(x, digits):
    """printf's form of the shortest decimal text of x, rounded half up."""
    if not math.isfinite(x):
        return f"{x:g}"
    d = Decimal(repr(x))
    if d:
        d = d.quantize(Decimal(1).scaleb(d.adjusted() - digits + 1), ROUND_HALF_UP)
    return f"%.{digits}g" % float(d)


def test_general_numbers(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 1.0, -1.5, 100000.0, 999999.0, 1e6, 1234567.0, 999999.9, 0.0001, 0.00001, -0.000123456, 1e100, 2.2250738585072014e-308, 1.2345678901234567e308, math.inf, -math.inf]
    xs += [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-12, 12) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 3, 6, 15):
        got = [r[0] for r in df.select(general(F.col("x"), digits)).collect()]
        assert [(x, g) for x, g in zip(xs, got)] == [(x, rounded_first(x, digits)) for x in xs]
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(general(F.col("x"))).collect()
    assert [r[0] for r in odd] == ["nan", None]


def test_dump_and_descriptions(spark):
    rows = spark.createDataFrame([(1, 2.50, None), (2, 1e-7, 3)], "id long, a double, b int")
    got = {(r.id, r.variable): r.line for r in K.dump(rows, ["id"], ["a", "b"]).collect()}
    assert got == {(1, "a"): "2.5", (1, "b"): None, (2, "a"): "1e-07", (2, "b"): "3"}
    points = spark.sql("select 'a<b' as variable, double(lon) lon, double(lat) lat, timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, int(lon)) as ts from values (10, 20), (12, null), (14, 30) as t(lon, lat)")
    line = K.descriptions(K.extents(points, "variable").withColumns({"units": F.lit(None).cast("string"), "description": F.lit("x & y")})).head().line
    assert "<name>a&lt;b</name><label>a&lt;b()</label><description>x &amp; y</description>" in line
    assert "<gml:pos>10.00 20.00</gml:pos><gml:pos>14.00 30.00</gml:pos>" in line
    assert "<beginPosition>2024-01-11T05:00:00Z</beginPosition><endPosition>2024-01-15T05:00:00Z</endPosition>" in line
    assert K.descriptions(K.extents(points.limit(0), "variable").withColumns({"units": F.lit(""), "description": F.lit("")})).count() == 0


def test_surface_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,FIPS,Lat,Lon,o3,err\nJAN-05-2001,01001,32.5,-86.5,41.25,3.5\nFeb-30-2001,1,1,1,1,1\nMar-03-2001,7,1,x,1,1\nDec-31-2012,1234567890123,1,1,1,1\n\nDec-31-2012,9,-1.5,2,0,0\nJan-01-2001,,1,1,1,1\n")
    got = sorted(r.line for r in S.surface_lines(spark, str(tmp_path)).collect())
    assert got == ["2001/01/05,00000001001,-086.50000,032.50000,00041.250,00003.5000", "2012/12/31,00000000009,0002.00000,-01.50000,00000.000,00000.0000"]
    assert len({len(x) for x in got}) == 1


def test_coordinates_read_the_files_once_a_step(spark, tmp_path):
    """What is found of splits and files isn't found anew by each later step."""
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text(coordinate_file(2, 2, [(k, 1), (k, 2), (k, 3), (k, 4)]))
    df = N.coordinates(spark, str(tmp_path))
    assert df.count() == 12
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
