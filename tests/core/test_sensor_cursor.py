import json

import pytest
from pyspark.sql import functions as F

from geoflume.sources import sensor_cursor as C


def put(folder, stamp, ids, text=None):
    folder.mkdir(exist_ok=True)
    data = {"data_time_stamp": 1700000000 + int(stamp[-6:]), "fields": ["id", "pm25", "name"], "data": [[i, i * 1.5, None] for i in ids]}
    (folder / f"sensors_{stamp}.json").write_text(json.dumps(data, indent=1) if text is None else text)


def run(spark, folder, out, broken=()):
    def write(batch, n):
        rows = batch.select("stamp", "taken", F.col("reading")["id"].cast("long").alias("id"), F.col("reading")["pm25"].cast("double").alias("pm25")).cache()
        if n in broken:
            rows.count()
            raise RuntimeError("stopped in the middle")
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = C.snapshots(spark, str(folder), wait="0").writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def ids(spark, out):
    return sorted(r.id for r in spark.read.parquet(str(out)).collect())


def test_each_row_once_over_stops_and_starts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    put(src, "20240101000000", range(5))
    put(src, "20240101000200", range(5, 9))
    run(spark, src, out)
    assert ids(spark, out) == list(range(9))
    run(spark, src, out)
    assert ids(spark, out) == list(range(9))
    put(src, "20240101000400", range(9, 12))
    put(src, "20240101000600", [], '{"error": "no such key"}')
    put(src, "20240101000700", [], '{"data_time_stamp": 1, "fields": ["id"], "data": [[1')
    put(src, "20240101000800", range(12, 14))
    with pytest.raises(Exception, match="stopped in the middle"):
        run(spark, src, out, broken={1, 2})
    put(src, "20240101000900", range(14, 15))
    for _ in range(2):  # the first ends the batch that was stopped
        run(spark, src, out)
    assert ids(spark, out) == list(range(15))
    assert sorted(p.name for p in src.iterdir() if p.suffix == ".bad") == ["sensors_20240101000600.json.bad", "sensors_20240101000700.json.bad"]
    row = spark.read.parquet(str(out)).filter("id = 9").first()
    assert (row.stamp, row.taken, row.pm25) == ("20240101000400", 1700000400, 13.5)


def test_a_newest_file_in_quarantine_and_an_empty_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    run(spark, src, out)
    put(src, "20240101000000", range(2))
    put(src, "20240101000100", [], "")
    run(spark, src, out)
    run(spark, src, out)
    put(src, "20240101000300", range(2, 4))
    run(spark, src, out)
    assert ids(spark, out) == [0, 1, 2, 3]


def test_tries(tmp_path, monkeypatch):
    src = tmp_path / "in"
    put(src, "20240101000000", [1])
    reader = C.CursorReader({"path": str(src), "wait": "0"})
    seen = []

    def flaky(text, least):
        seen.append(1)
        if len(seen) < 3:
            raise ValueError("not whole yet")
        return json.loads(text)

    monkeypatch.setattr(C, "whole", flaky)
    [part] = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [b.num_rows for b in reader.read(part)] == [1] and len(seen) == 3


@pytest.mark.parametrize("text", ["[]", '{"fields": ["a"], "data": [[1, 2]]}', '{"fields": ["a"], "data": []}', '{"fields": null, "data": [[1]]}', "{"])
def test_what_is_malformed(text):
    with pytest.raises(ValueError):
        C.whole(text, 1)
