"""Structured Streaming: closed hours and days, and latest snapshots. Events: streaming.detect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sensor_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON files under a path; malformed lines end up in _corrupt_record."""
    return spark.readStream.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def good(df: DataFrame) -> DataFrame:
    return df.filter("_corrupt_record is null").drop("_corrupt_record")


def closed_means(stream: DataFrame, period: str, late: str, ts: str = "ts") -> DataFrame:
    """sensor, start, value, n of each period, given out once when the watermark has passed its end."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy("sensor", F.window(ts, period)).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return out.select("sensor", F.col("window.start").alias("start"), "value", "n")


def latest(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """The last value of each sensor, for update mode."""
    return stream.groupBy("sensor").agg(F.max(ts).alias(ts), F.max_by("value", ts).alias("value"))


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Closed rows into one folder a batch: a batch that runs again replaces its own folder, so no row counts twice."""

    def write(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
