"""Numbers of the lines of text files, and coordinate files, whose points go by their place.

A split of a file starts at a known byte and its lines come in order, so a line's
number is the count of lines in the splits before its own and its place in its own.
Nothing is sorted: one row for each split is added up, the lines stay where they are.
What is found of splits and files is checkpointed, so that each step reads the files once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.operators.exact import checkpointed
from geoflume.operators.joins import small


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0 in each file), line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    splits = checkpointed(splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")))
    return lines.join(small(splits), ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("number"), "line")


#: Tags of the lines that tell a coordinate file's header lines, columns and rows. Fixed values.
TAGS = {"header": "hdr_lines", "cols": "NX", "rows": "NY"}


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, lon, lat of coordinate files: a header, then a line of x, y, latitude and longitude a point, row by row.

    A file with too few points, or with one that can't be read or lies off the
    globe, gives none; lines after the last point have no effect.
    """
    lines = numbered_lines(spark, path)
    count = F.regexp_extract("line", r":\s*(\d+)", 1).try_cast("int")
    told = lines.filter(F.rlike("line", F.lit("^(" + "|".join(TAGS.values()) + ")")))
    heads = told.groupBy("file").agg(*[F.min_by(F.when(F.startswith("line", F.lit(t)), count), F.when(F.startswith("line", F.lit(t)), F.col("number"))).alias(n) for n, t in TAGS.items()])
    heads = small(checkpointed(heads.filter("header > 0 and cols > 0 and rows > 0")))
    place = F.col("number") - F.col("header")
    words = F.split(F.trim("line"), r"\s+")
    points = lines.join(heads, "file").filter((place >= 0) & (place < F.col("rows").cast("long") * F.col("cols")))
    points = points.select("file", "rows", "cols", place.alias("place"), F.get(words, F.lit(3)).try_cast("double").alias("lon"), F.get(words, F.lit(2)).try_cast("double").alias("lat"))
    points = points.filter("lon between -180 and 180 and lat between -90 and 90")
    whole = points.groupBy("file").agg(F.count("*").alias("n"), F.first("rows").alias("r"), F.first("cols").alias("c")).filter(F.col("n") == F.col("r").cast("long") * F.col("c"))
    return points.join(small(checkpointed(whole.select("file"))), "file").select("file", F.floor(F.col("place") / F.col("cols")).alias("row"), (F.col("place") % F.col("cols")).alias("col"), "lon", "lat")
