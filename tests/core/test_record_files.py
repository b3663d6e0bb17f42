import numpy as np
import pytest
from pyspark.sql import functions as F

from geoflume.sources import binary as B
from geoflume.sources import record_files as R


@pytest.fixture(scope="module")
def source(spark):
    return R.register(spark)


def day_points(spark, days, per_day):
    at = F.col("id")
    day = F.date_format(F.expr("date_add(date'2023-01-01', cast(id div %d as int))" % per_day), "yyyyMMdd").cast("double") * 1e6
    return spark.range(days * per_day).select(F.concat(F.lit("n"), at % 7).alias("note"), (day + at % 86400 % 60).alias("stamp"), (at % 360 - 180.0).alias("lon"), (at % 180 - 90.0).alias("lat"), F.lit(1.5).alias("elevation"), at.alias("id"), (at / 7).alias("value"))


COLS = ["note", *B.COLUMNS]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_written_points_are_read_back(source, tmp_path):
    at = str(tmp_path / "p")
    df = day_points(source, 30, 200)
    R.write_points(df, at, "pm25", "ug/m3", "2023-01-01T00:00:00-0000", partitions=3)
    back = source.read.format("point_stream").option("splitbytes", 50_000).load(at)
    assert back.rdd.getNumPartitions() > 6
    assert rows_of(back) == sorted((r.note, r.stamp, r.lon, r.lat, r.elevation, float(r.id), r.value) for r in df.collect())
    names = {p.name for p in (tmp_path / "p").iterdir()}
    assert "_SUCCESS" in names and "_temporary" not in names and len(names) == 4
    R.write_points(df.limit(5), at, "pm25", "ug/m3", "-", mode="overwrite", partitions=1)
    assert source.read.format("point_stream").load(at).count() == 5


def test_time_range_is_sought_and_exact(source, tmp_path):
    at = str(tmp_path / "p")
    df = day_points(source, 20, 100)
    R.write_points(df, at, "pm25", "ug/m3", "-", partitions=2)
    back = source.read.format("point_stream").option("splitbytes", 40_000).load(at)
    for low, high in ((20230105000000.0, 20230105999999.0), (20230110000010.0, 20230112000000.0), (0.0, 1.0)):
        for cond in (F.col("stamp").between(low, high), (F.col("stamp") > low) & (F.col("stamp") < high), F.col("stamp") == low):
            assert rows_of(back.filter(cond)) == rows_of(df.select(*[F.col(c).cast("double").alias(c) if c != "note" else F.col(c) for c in COLS]).filter(cond))
    assert back.filter("stamp >= 20230105000000 and lon > 0 and note = 'n3'").count() == df.filter("stamp >= 20230105000000 and lon > 0 and note = 'n3'").count()
    plan = back.filter("stamp >= 20230105000000")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(stamp" in plan and ">=" not in plan  # the comparison is the source's


def test_one_day_reads_under_a_hundredth_of_the_bytes(source, tmp_path):
    days, per = 365, 400
    n = days * per
    stamp = np.repeat(20230000000000.0 + np.arange(days) * 1e6, per)
    rows = {c: stamp if c == "stamp" else np.arange(n, dtype=float) for c in B.COLUMNS}
    (tmp_path / "one.xdr").write_bytes(B.encode(rows, [""] * n, "v", "m", "-", "geoflume,sorted"))
    fs, path = R.file_system(str(tmp_path / "one.xdr"))
    size, parts, read, got = fs.get_file_info(path).size, 16, 0, 0
    day = stamp[200 * per]
    for k in range(parts):
        f = R.Bytes(fs, path)
        got += sum(b.num_rows for b in R.read_part(R.PointRecords(f), k, parts, R.Range((day, False), (day, True))))
        read += f.read
    assert got == per and read < size / 100, (read, size)


def test_unsorted_and_foreign_streams(source, tmp_path):
    (tmp_path / "p").mkdir()
    rows = {c: np.array([3.0, 1.0, 2.0]) for c in B.COLUMNS}
    (tmp_path / "p" / "a.xdr").write_bytes(B.encode(rows, ["c", "a", "b"], "v", "m", "-"))
    df = source.read.format("point_stream").load(str(tmp_path / "p"))
    assert sorted(r.note for r in df.filter("stamp >= 2").collect()) == ["b", "c"]
    wide = "\n".join(["Point 1.0", "https://x", "-", "# Dimensions: variables points", "7 2", "# Variable names:", "timestamp longitude latitude elevation id count pm25", "# Variable units:", "- - - - - - -", "# char notes[points][80] and", "# IEEE-754 64-bit reals data[variables][points]:"]) + "\n"
    (tmp_path / "p" / "a.xdr").write_bytes(wide.encode() + b"one".ljust(80, b"\0") + b"two".ljust(80, b"\0") + np.arange(14, dtype=">f8").tobytes())
    df = source.read.format("point_stream").load(str(tmp_path / "p"))  # a scan lists its files once
    assert sorted((r.note, r.stamp, r.id, r.value) for r in df.collect()) == [("one", 0.0, 8.0, 12.0), ("two", 1.0, 9.0, 13.0)]
    (tmp_path / "p" / "a.xdr").write_bytes(b"nothing of the kind\n# IEEE\n")
    with pytest.raises(Exception, match="not a point stream"):
        source.read.format("point_stream").load(str(tmp_path / "p")).collect()


def test_a_failed_job_leaves_nothing(source, tmp_path):
    at = tmp_path / "p"
    df = day_points(source, 3, 100)
    R.write_points(df, str(at), "v", "m", "-", partitions=2)
    before = {p.name for p in at.iterdir()}
    late = df.withColumn("value", F.when(F.col("id") < 290, F.col("value")).otherwise(F.raise_error(F.lit("broken"))))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            R.write_points(late, str(at), "v", "m", "-", mode=mode, partitions=2)
        assert {p.name for p in at.iterdir()} == before and source.read.format("point_stream").load(str(at)).count() == 300


def test_an_attempt_that_was_killed_isnt_committed(tmp_path):
    w = R.GridWriter({"path": str(tmp_path / "g"), "rows": "2", "cols": "2"}, False)
    import pyarrow as pa

    batch = lambda *h: pa.RecordBatch.from_pydict({"hour": list(h), "row": [0] * len(h), "col": [0] * len(h), "value": [1.0] * len(h)})

    def dies():
        yield batch(1, 2)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(dies())
    done = w.write(iter([batch(1, 2)]))
    assert not R.files_in(*R.file_system(str(tmp_path / "g")))
    w.commit([done, None])
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == ["1.bin", "2.bin", "_SUCCESS"]


def test_grids(source, tmp_path):
    cells = source.range(600).select((F.col("id") % 5).alias("hour"), (F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), (F.col("id") / 2).alias("value"))
    R.write_grids(cells, str(tmp_path / "g"), 10, 60)
    back = source.read.format("grid_f32").options(rows=10, cols=60).load(str(tmp_path / "g"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    one = np.frombuffer((tmp_path / "g" / "3.bin").read_bytes(), ">f4").reshape(10, 60)
    assert one[9, 3] == 1.5 and one[0, 543 % 60] == 543 / 2 and one[9, 4] == -9999


def test_day_records(source, tmp_path):
    lines = [f"2023-{1 + d // 28:02}-{1 + d % 28:02},{s:05},{s * 1.25:9.3f}" for d in range(90) for s in range(40)]
    (tmp_path / "2023.txt").write_text("Date,FIPS,value\n" + "\n".join(lines) + "\n")
    df = source.read.format("day_records").option("splitbytes", 20_000).load(str(tmp_path))
    assert df.columns == ["Date", "FIPS", "value"] and df.rdd.getNumPartitions() > 3 and df.count() == 3600
    got = df.filter("Date between '2023-02-01' and '2023-02-03'").collect()
    assert sorted(f"{r.Date},{r.FIPS},{float(r.value):9.3f}" for r in got) == sorted(x for x in lines if "2023-02-01" <= x[:10] <= "2023-02-03")
    (tmp_path / "2024.txt").write_text("Date,FIPS,value\n2024-01-01,1,2\n2024,1,2\n")
    with pytest.raises(Exception, match="aren't lines of"):
        source.read.format("day_records").load(str(tmp_path)).collect()
