"""Sources in text formats as DataFrames, and the variable catalogue.

Each reader gives nulls for missing values and a timestamp in UTC. Paths are
whatever Spark reads; dates in paths become partition columns where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflume.functions import timecodes
from geoflume.operators.filters import complete, null_missing, without_numbered

CATALOG = T.StructType(
    [T.StructField(n, t) for n, t in (("product", T.StringType()), ("variable", T.StringType()), ("units", T.StringType()), ("scale", T.DoubleType()), ("valid_min", T.DoubleType()), ("valid_max", T.DoubleType()), ("qc_variable", T.StringType()))]
)


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The variables of products: product, variable, units, scale, valid range, quality variable."""
    return spark.createDataFrame(rows, CATALOG)


def sensor_csv(spark: SparkSession, path: str, time: str, drop_numbered: bool = False) -> DataFrame:
    """CSV with a header; ``time`` becomes ts, and rows without a readable time go."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.withColumn("ts", timecodes.from_text(F.col(f"`{time}`"))).filter("ts is not null")
    return without_numbered(df) if drop_numbered else df


def required_csv(spark: SparkSession, path: str, required: list[str], **options) -> DataFrame:
    """CSV rows of which the required columns aren't empty."""
    return complete(spark.read.csv(path, header=True, **options), *[f"`{c}`" for c in required])


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]], skip: str | None = None) -> DataFrame:
    """Lines cut into (name, first character from 1, length, type); lines matching ``skip`` go; unreadable numbers are null."""
    lines = spark.read.text(path)
    if skip:
        lines = lines.filter(~F.rlike("value", F.lit(skip)))
    return lines.select(*[F.trim(F.substring("value", a, n)).try_cast(t).alias(c) for c, a, n, t in fields])


def wide_hours(df: DataFrame, prefix: str, keys: list[str], year: str = "year", day: str = "day") -> DataFrame:
    """Columns prefix1 … prefix24 of a day as rows with ts: hour h is h - 1 after midnight."""
    names = [f"{prefix}{h}" for h in range(1, 25)]
    long = df.unpivot([*keys, year, day], names, "name", "value")
    h = F.substring("name", len(prefix) + 1, 2).cast("int")
    start = F.to_timestamp(F.format_string("%d%03d", F.col(year), F.col(day)), "yyyyDDD")
    return long.select(*keys, F.timestamp_add("HOUR", h - 1, start).alias("ts"), null_missing(F.col("value").cast("double")).alias("value")).filter("value is not null")


def header_files(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row a file with what each regex's first group finds in its lines."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    return lines.groupBy("path").agg(*[F.max(F.nullif(F.regexp_extract("value", rx, 1), F.lit(""))).alias(n) for n, rx in fields.items()])


def sensor_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON with ``fields`` (names) and ``data`` (arrays of values): rows with a map of strings and the file's stamp."""
    schema = "data_time_stamp long, fields array<string>, data array<array<string>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    rows = files.select("data_time_stamp", "fields", F.explode("data").alias("v"))
    return rows.select(F.timestamp_seconds("data_time_stamp").alias("stamp"), F.map_from_arrays("fields", "v").alias("row"))


def water_xml(spark: SparkSession, path: str, row: str = "value") -> DataFrame:
    """Values of an XML time series with their attributes."""
    return spark.read.format("xml").option("rowTag", row).option("valueTag", "reading").load(path)


def granules(spark: SparkSession, path: str, pattern: str = r"_(\d{8})T(\d{2})") -> DataFrame:
    """Files under a path with the date and hour of their names, without reading their content."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    stamp = F.concat(F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2))
    return files.withColumn("ts", F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMddHH")), timecodes.of_file_name(F.col("path"))))


def latest(files: DataFrame, by: list[str], version: str) -> DataFrame:
    """All files of the newest version of each group."""
    from pyspark.sql import Window as W

    return files.withColumn("__r", F.rank().over(W.partitionBy(*by).orderBy(F.desc(version)))).filter("__r = 1").drop("__r")


def month_name_date(text: Column) -> Column:
    """JAN-05-2001 and the like as a date."""
    return F.to_date(F.try_to_timestamp(F.initcap(text), F.lit("MMM-dd-yyyy")))


def surface_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: of comma-separated month-name date, county, latitude, longitude, measure and its error,
    the same with a date of digits, longitude before latitude and every field of one width, zeros in front.

    Headers and other lines without a date or with a number that can't be read go.
    """
    c = F.split("value", ",")
    lat, lon, measure, error = (F.get(c, F.lit(k)).try_cast("double") for k in (2, 3, 4, 5))
    county = F.trim(F.get(c, F.lit(1)))
    line = F.concat_ws(",", F.date_format(month_name_date(F.get(c, F.lit(0))), "yyyy/MM/dd"), F.lpad(county, 11, "0"), F.format_string("%010.5f,%09.5f,%09.3f,%010.4f", lon, lat, measure, error))
    read = month_name_date(F.get(c, F.lit(0))).isNotNull() & (county != "") & (F.length(county) <= 11)
    for number in (lat, lon, measure, error):
        read = read & number.isNotNull()
    return spark.read.text(path).filter(read).select(line.alias("line"))
