"""Plain operations on relations: cuts, places, ranges, pages, and swaths one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.operators.joins import small


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among those of ids; a key of ids may stand there often."""
    return df.join(ids.select(key), key, "left_semi")


def subset(df: DataFrame, ranges: dict[str, tuple] | None = None, values: dict[str, list] | None = None) -> DataFrame:
    """The rows within all ranges (column to ends, both count, None is open) and with all columns of ``values`` among theirs; nulls are in none."""
    for name, (low, high) in (ranges or {}).items():
        c = F.col(name)
        df = df.filter(c.isNotNull() if low is None else c >= F.lit(low))
        df = df if high is None else df.filter(c <= F.lit(high))
    for name, among in (values or {}).items():
        df = df.filter(F.col(name).isin(*among))
    return df


def above_sea(levels: DataFrame, sites: DataFrame, on: str, height: Column, ground: str = "ground") -> DataFrame:
    """Levels with elevation: height above ground and the ground of their site above sea; null where the site isn't known."""
    return levels.join(small(sites.select(on, F.col(ground).alias("__ground"))), on, "left").withColumn("elevation", height + F.col("__ground")).drop("__ground")


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, least, most, n of each column as doubles: one aggregate over the rows, not a row for each value."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.count(c).alias("n")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`.least"), F.col(f"`{c}`.most"), F.col(f"`{c}`.n")) for c in columns])).alias("r")).select("r.*")


def scaled_mean(df: DataFrame, by: list[str], value: str, scale: float, places: int = 0) -> DataFrame:
    """by, value, n: means in units of 1 / scale. Values are scaled and rounded before they are added up as decimals, so the mean is the same in any order."""
    whole = F.round(F.col(value) * scale, places).cast("decimal(28,6)")
    out = df.groupBy(*by).agg(F.sum(whole).alias("__s"), F.count(whole).alias("n"))
    return out.select(*by, F.when(F.col("n") > 0, F.col("__s").cast("double") / F.col("n")).alias(value), "n")


def named(values: DataFrame, periods: dict[str, Column], by: list[str], value: str, ts: str = "ts") -> DataFrame:
    """name, by, start, value: means by each period, named <period>_mean_<value>. periods: name to what a time is cut to."""
    out = None
    for name, cut in periods.items():
        one = values.groupBy(*by, cut.alias("start")).agg(F.avg(value).alias("value")).select(F.lit(f"{name}_mean_{value}").alias("name"), *by, "start", "value")
        out = one if out is None else out.unionByName(one)
    return out


def by_field(files: DataFrame, group: list[str], field: int, path: str = "path", sep: str = "_") -> DataFrame:
    """Files with the field (from 1) of their path and their place by it within a group; the path decides ties."""
    rows = files.withColumn("field", F.split_part(path, F.lit(sep), F.lit(field)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("field", path)))


def shuffled(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """Places of a shuffle within each group that a seed repeats, however the rows are dealt."""
    name = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(name, key)))


def paged(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """The page, from 0, of each row of its group."""
    return df.withColumn("page", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size))


def flipped(cells: DataFrame, rows: int, row: str = "row") -> DataFrame:
    """North for south: the first row is the last."""
    return cells.withColumn(row, (F.lit(rows - 1) - F.col(row)).cast(cells.schema[row].dataType))


def transposed(cells: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Rows for columns."""
    return cells.withColumnsRenamed({row: "__t", col: row}).withColumnRenamed("__t", col).select(*cells.columns)


def in_sequence(pixels: DataFrame, swath: str, order: Column, row: str = "row") -> DataFrame:
    """Swaths as one: rows go on from swath to swath in order, with ``scan`` (from 0) beside them; a swath has as many scans as its largest row says.

    Counts of scans are one row a swath, which are summed up before they come back to
    the pixels; the pixels meet no window.
    """
    each = pixels.groupBy(swath).agg((F.max(row) + 1).alias("__n"), F.min(order).alias("__o"))
    before = F.sum("__n").over(W.orderBy("__o", swath).rowsBetween(W.unboundedPreceding, -1))  # one row a swath
    starts = each.select(swath, F.coalesce(before, F.lit(0)).alias("__before"))
    return pixels.join(small(starts), swath).withColumn("scan", F.col(row) + F.col("__before")).drop("__before")
