"""Filters and validity masks.

Functions that give a Column are masks or values (null where invalid); those that
take a DataFrame are meant for ``.transform``. Missing values are null inside the
engine; sentinels exist at sources and sinks only. Neutral thresholds (None) add
nothing to the plan, so the columns they would need aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values that stand for "missing" in files. Fixed values.
SENTINELS = (-9999.0, -9.999e36, -999.0)
#: Units whose products may be negative by noise.
SIGNED_UNITS = "molecules/cm2"
#: Valid ranges of some variables. Fixed values.
RANGES = {"aod550": (-0.05, 5.0), "angstrom": (-1.0, 3.0), "backscatter": (0.0, 540000.0), "height": (-500.0, 1e5)}


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside west, south, east, north; edges counted. A box with west > east is an error, as boxes don't cross the date line."""
    west, south, east, north = box
    if west > east or south > north:
        raise ValueError(f"not a box: {box}")
    return lon.between(west, east) & lat.between(south, north)


def in_time(ts: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Between two times, both counted; None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= start)
    if end is not None:
        out = out & (ts <= end)
    return out


def is_id(col: Column, wanted: int) -> Column:
    """Equal to the id; 0 is any."""
    return F.lit(True) if wanted == 0 else col == wanted


def null_missing(value: Column, sentinels: tuple[float, ...] = SENTINELS) -> Column:
    return F.when(~F.isnan(value) & ~value.isin(*sentinels) & (F.abs(value) < 1e30), value)


def at_least_quality(value: Column, quality: Column, least: int | None) -> Column:
    """The value where its quality is from least to 100; None or 0 switches the test off."""
    return F.when(quality.between(least, 100), value) if least else value


def at_most_cloud(value: Column, fraction: Column, most: float | None) -> Column:
    """The value where the cloud fraction is from 0 to most; None or 1 switches the test off."""
    return value if most is None or most >= 1.0 else F.when(fraction.between(0.0, most), value)


def in_columns(value: Column, col: Column, first: int | None, last: int | None) -> Column:
    """The value where the cross-track column is in the range; None switches the test off."""
    return value if first is None or last is None else F.when(col.between(first, last), value)


def with_flags(value: Column, *flags: Column) -> Column:
    """The value where all flags are 0."""
    out = value
    for f in flags:
        out = F.when(f == 0, out)
    return out


def scaled(value: Column, scale: float, low: float, high: float, units: str = "", allow_negative: bool = False) -> Column:
    """value * scale where that is in the range. Negative values may be let through for column densities."""
    if allow_negative and units == SIGNED_UNITS:
        low = -1e29
    v = value.cast("double") * scale
    return F.when(v.between(low, high), v)


def in_flag_range(value: Column, flag: Column, low: float, high: float) -> Column:
    """The value where its flag is in the range."""
    return F.when(flag.between(low, high), value)


def in_range_of(value: Column, variable: str) -> Column:
    """The value where it is in the valid range of the variable, by RANGES."""
    return F.when(value.between(*RANGES[variable]), value)


def scored(value: Column, score: Column, least: float | None = None, uncertainty: Column | None = None, most: float | None = None) -> Column:
    """The value where its classification score is at least, and its uncertainty at most, so much; a missing uncertainty passes none."""
    out = value if least is None else F.when(score >= least, value)
    return out if uncertainty is None or most is None else F.when(uncertainty.between(0.0, most), out)


def corners_in_box(lons: list[Column], lats: list[Column], box: tuple[float, float, float, float]) -> Column:
    """Whether the box of a cell's corners shares a point with the box."""
    west, south, east, north = box
    return (F.least(*lons) <= east) & (F.greatest(*lons) >= west) & (F.least(*lats) <= north) & (F.greatest(*lats) >= south)


def levels_between(profiles: DataFrame, elevations: str, values: str, low: float, high: float) -> DataFrame:
    """A row for each level of a profile whose elevation is in the range and whose value isn't missing: level (from 0), elevation, value in place of the arrays."""
    rest = [c for c in profiles.columns if c not in (elevations, values)]
    rows = profiles.select(*rest, F.posexplode(F.arrays_zip(F.col(elevations).alias("elevation"), F.col(values).alias("value"))).alias("level", "__l"))
    return rows.select(*rest, "level", "__l.elevation", "__l.value").filter(F.col("elevation").between(low, high) & F.col("value").isNotNull())


def at_times(text: Column, wanted: str) -> Column:
    """ISO times equal to one of 20 characters, or between two of them joined by a slash."""
    first, _, last = wanted.partition("/")
    return text.between(first, last) if last else text == first


def released(version: Column, day: Column, least: str, days: tuple[int, ...] = (), ranges: tuple[tuple[int, int], ...] = ()) -> Column:
    """Files of a version from ``least`` on, or of a listed day, or of a day in a listed range."""
    out = (version >= least) | day.isin(*days)
    for low, high in ranges:
        out = out | day.between(low, high)
    return out


def of_analyte(df: DataFrame, analyte: str, column: str = "analyte", value: str = "value") -> DataFrame:
    """Rows of one analyte that aren't negative."""
    return df.filter((F.col(column) == analyte) & (F.col(value) >= 0))


def in_named_box(df: DataFrame, box: tuple[float, float, float, float], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows in the box, by the first columns whose names hold the texts, in either case."""
    find = lambda text: F.col("`" + next(c for c in df.columns if text in c.lower()) + "`")
    return df.filter(in_box(find(lon).cast("double"), find(lat).cast("double"), box))


def decoded(encoded: Column, offset: float, scale: float, low: float, high: float) -> Column:
    """(encoded - offset) * scale where the encoded value is in the range; a range with low > high is none."""
    v = (encoded.cast("double") - offset) * scale
    return v if low > high else F.when(encoded.between(low, high), v)


def high_code(long_name: Column) -> Column:
    """The code of high quality as named in an attribute text like '0: low, 3: high'; 0 where none is named."""
    code = F.regexp_extract(F.lower(long_name), r"(\d+)[ :=]*high", 1)
    return F.when(code == "", 0).otherwise(code.try_cast("int"))


def of_quality(value: Column, code: Column, high: Column | int, allow_medium: bool = False) -> Column:
    """The value where its code is high, or next to high if medium is allowed."""
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when((code == high) | (F.lit(allow_medium) & (F.abs(code - high) == 1)), value)


def floored(value: Column, least: float = -999.0) -> Column:
    return F.greatest(value, F.lit(least))


def starts_with(layer: Column, prefix: str) -> Column:
    return layer.startswith(prefix)


def has_level(name: Column, level: str) -> Column:
    """The level is named after the first character."""
    return F.instr(name, f"_{level}") > 1


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of which the columns are neither null nor empty."""
    out = df
    for c in columns:
        out = out.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return out


def without_numbered(df: DataFrame) -> DataFrame:
    """Columns whose names don't end in a digit."""
    return df.select(*[f"`{c}`" for c in df.columns if not c[-1:].isdigit()])


def monotonic(df: DataFrame, order: str, ts: str, by: list[str]) -> DataFrame:
    """Rows that aren't earlier than the row before, by order within a group; a row that goes rejects none."""
    before = F.lag(ts).over(W.partitionBy(*by).orderBy(order))
    earlier = F.lag(ts, 2).over(W.partitionBy(*by).orderBy(order))
    dropped = F.coalesce(before < earlier, F.lit(False))
    rows = df.withColumn("__keep", before.isNull() | dropped | (F.col(ts) >= before))
    return rows.filter("__keep").drop("__keep")


def stride(df: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """Every n-th row of each group, from the first on."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("__k", k).filter(F.col("__k") % n == 0).drop("__k")


def sparse(df: DataFrame, target: int, order: list[str], by: list[str]) -> DataFrame:
    """About so many rows of each group, evenly spaced: every n-th, n being the rows over the target."""
    w = W.partitionBy(*by)
    k = F.row_number().over(w.orderBy(*order)) - 1
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / target))
    return df.withColumn("__k", k % n).filter("__k = 0").drop("__k")


def whole_files(rows: DataFrame, path: str, line: str, width: int, sep: str = ",") -> DataFrame:
    """Rows of files in which every line has at least so many fields."""
    bad = rows.groupBy(path).agg(F.min(F.size(F.split(line, sep))).alias("__n")).filter(F.col("__n") < width).select(path)
    return rows.join(bad, path, "left_anti")


def index_window(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float], by: list[str]) -> DataFrame:
    """The row and column window of a curvilinear grid that holds all cells in the box, by group."""
    inside = df.filter(in_box(F.col(lon), F.col(lat), box))
    return inside.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])


def require_nonempty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no points were in the subset")
    return df
