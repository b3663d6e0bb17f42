"""Monitoring surveys, sites, flights and series with the column rules of their files.

Columns go by place (from 0), as headers of these files differ by year. A row
that lacks a required column, or whose numbers can't be read, goes; so do headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.functions import text as X

#: Variables of wide surveys: column, and columns of quality notes. Fixed values.
WIDE = {"chlorophyll_a": (22, (35,)), "dissolved_oxygen": (19, ()), "dissolved_inorganic_nitrogen": (23, (36,)), "dissolved_inorganic_phosphorus": (24, (37,)), "di_nitrogen_phosphorus_ratio": (27, (36, 37))}
#: Analytes of long surveys. Fixed values.
LONG = {"chlorophyll_a": "CHLA", "conductivity": "COND", "dissolved_inorganic_nitrogen": "DIN", "microcystin": "MICX"}
#: Zones of water-quality series.
ZONES = {"eastern": "America/New_York", "central": "America/Chicago", "mountain": "America/Denver", "pacific": "America/Los_Angeles", "utc": "UTC"}


def _cells(spark: SparkSession, path: str, least: int) -> DataFrame:
    """c: the cells of each line that has at least so many."""
    line = F.regexp_replace("value", r"[\r\x0b\x0c]", "")
    return spark.read.text(path).select(F.split(line, ",").alias("c")).filter(F.size("c") >= least)


def _at(k: int) -> Column:
    return F.get("c", F.lit(k))


def _number(k: int) -> Column:
    return _at(k).try_cast("double")


def _filled(*columns: int) -> Column:
    out = F.lit(True)
    for k in columns:
        out = out & (_at(k) != "")
    return out


def _survey_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a wide survey with their required columns, site, day, lon and lat."""
    day = F.try_to_date(F.concat_ws("/", _at(7), F.split_part(_at(8), F.lit("/"), F.lit(1)), F.split_part(_at(8), F.lit("/"), F.lit(2))), "yyyy/M/d")
    rows = _cells(spark, path, 44).filter(_filled(0, 7, 8, 9, 10, 11, 13) & (F.size(F.split(_at(8), "/")) == 3))
    rows = rows.select("c", _at(0).alias("site"), day.alias("day"), (_number(7) * 1000 + _number(9)).cast("int").alias("yearday"), _number(11).alias("lon"), _number(10).alias("lat"))
    return rows.filter("day is not null and yearday is not null and lon is not null and lat is not null")


def survey_wide(spark: SparkSession, path: str, variable: str, level: str = "") -> DataFrame:
    """site, station, day, yearday, lon, lat, depth, value and note of a variable of WIDE; level: surface, mid-water, bottom or any.

    Depths are negative. A sample at the surface is at -0.1, one in mid-water at half
    the depth of the bottom. The note has the site, its visit and layer, subregions,
    date of publication and the variable's quality notes.
    """
    column, quality = WIDE[variable]
    rows = _survey_rows(spark, path).withColumns({"value": _number(column), "bottom": _number(15), "layer": _at(6)})
    rows = rows.filter(_filled(2, 6) & (F.col("value") >= 0) & (F.col("bottom") >= 0))
    if level:
        rows = rows.filter(F.instr("layer", f"_{level.upper()}") > 1)
    depth = F.when(F.contains("layer", F.lit("_SURFACE")), -0.1).when(F.contains("layer", F.lit("_MID-WATER")), -0.5 * F.col("bottom")).otherwise(-F.col("bottom"))
    note = F.concat_ws(" ", "site", "layer", _at(13), F.concat(F.lit("Pub:"), _at(2)), *map(_at, quality))
    return rows.select("site", X.site_number(F.col("site")).alias("station"), "day", "yearday", "lon", "lat", depth.alias("depth"), "value", note.alias("note"))


def survey_sites(spark: SparkSession, path: str) -> DataFrame:
    """site, station, day, lon, lat, note: each site of a wide survey once, by its first day."""
    rows = _survey_rows(spark, path).withColumn("note", F.concat_ws(" ", "site", _at(13)))
    first = rows.groupBy("site").agg(F.min(F.struct("day", "lon", "lat", "note")).alias("r"))
    return first.select("site", X.site_number(F.col("site")).alias("station"), "r.*")


def survey_long(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """site, station, day, lon, lat, depth, value and note of an analyte of LONG; results under 0 go, the detection limits, flag and method are in the note."""
    rows = _cells(spark, path, 15).filter(_filled(*range(15)) & (_at(8) == LONG[variable]))
    note = F.concat(_at(0), F.lit(";"), _at(3), F.lit(";ESTCODE:"), _at(4), F.lit(";lrl:"), _at(11), F.lit(";mdl:"), _at(12), F.lit(";flag:"), _at(14), F.lit(";method:"), _at(13))
    rows = rows.select(_at(0).alias("site"), _at(3).try_cast("long").alias("station"), F.try_to_date(_at(1), "yyyy-MM-dd").alias("day"), _number(5).alias("lon"), _number(6).alias("lat"), (-F.abs(_number(7))).alias("depth"), _number(9).alias("value"), note.alias("note"))
    return rows.filter("value >= 0 and day is not null and lon is not null and lat is not null")


def flight_name(name: str) -> str:
    """A column of a flight file by its usual name."""
    for old, new in (("Mixing Ratio", "NO2"), ("HSRL ", ""), (" (", "("), ("ML(", "MLH(")):
        name = name.replace(old, new) if old != "ML(" or name.startswith("ML(") else name
    return name.strip()


def flights(spark: SparkSession, path: str, missing: float = -9999.0) -> DataFrame:
    """Flight CSV with its usual column names and doubles; the missing value is null. exact.write_ordered writes it in order."""
    rows = spark.read.csv(path, header=True)
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")).try_cast("double"), F.lit(missing))
    return rows.select(*[value(c).alias(flight_name(c)) for c in rows.columns])


def sites(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """id, lon, lat, note of the sites of a box, from lines of those four words."""
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(w) >= 4).select(F.get(w, F.lit(0)).try_cast("long").alias("id"), F.get(w, F.lit(1)).try_cast("double").alias("lon"), F.get(w, F.lit(2)).try_cast("double").alias("lat"), F.get(w, F.lit(3)).alias("note"))
    return rows.filter(F.col("id").isNotNull() & F.col("lon").between(west, east) & F.col("lat").between(south, north))


_SERIES = "device string, parameters array<struct<name:string,unit:string,data:array<struct<timestamp:string,value:double>>>>"


def zoned_series(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """device, name, unit, ts (UTC), value from JSON documents whose stamps are local to a zone of ZONES; daylight saving counts."""
    rows = spark.read.schema(_SERIES).json(path, multiLine=True).select("device", F.explode("parameters").alias("p"))
    rows = rows.select("device", "p.name", "p.unit", F.explode("p.data").alias("d"))
    ts = F.to_utc_timestamp(F.try_to_timestamp("d.timestamp"), ZONES[zone.lower()])
    return rows.select("device", "name", "unit", ts.alias("ts"), F.col("d.value").alias("value")).filter("ts is not null and value is not null")


_WATER = """sourceInfo struct<siteCode:string,geoLocation:struct<geogLocation:struct<latitude:double,longitude:double>>>, variable struct<unit:struct<unitCode:string>>,
values struct<value:array<struct<_dateTime:string,_VALUE:double>>>"""


def water_series(spark: SparkSession, path: str) -> DataFrame:
    """site, lon, lat, unit, ts, value: the values of XML time series, each with its site and unit; those without a site, a place or a unit go."""
    rows = spark.read.format("xml").option("rowTag", "timeSeries").option("ignoreNamespace", True).schema(_WATER).load(path)
    place = "sourceInfo.geoLocation.geogLocation"
    rows = rows.select(F.col("sourceInfo.siteCode").alias("site"), F.col(f"{place}.longitude").alias("lon"), F.col(f"{place}.latitude").alias("lat"), F.col("variable.unit.unitCode").alias("unit"), F.explode("values.value").alias("v"))
    rows = rows.select("site", "lon", "lat", "unit", F.try_to_timestamp("v._dateTime").alias("ts"), F.col("v._VALUE").alias("value"))
    return rows.filter("site <> '' and unit <> '' and lon between -180 and 180 and lat between -90 and 90 and value > -9999 and ts is not null")


def masked(df: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """The rows of a CSV whose key is that of one of the shapes that a mask has kept; keys are compared as trimmed text."""
    keys = shapes.select(F.trim(F.col(key).cast("string")).alias("__k")).distinct()
    return df.withColumn("__k", F.trim(F.col(key).cast("string"))).join(keys, "__k", "left_semi").drop("__k")
