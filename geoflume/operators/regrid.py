"""Points, levels and quadrilaterals onto grid cells, and cells onto longer periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflume.functions.grid import Grid


def to_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Points inside the grid, with row and col."""
    col, row = grid.cell(F.col("lon"), F.col("lat"))
    return points.withColumn("col", col).withColumn("row", row).filter(F.col("col").isNotNull() & F.col("row").isNotNull())


def regrid(points: DataFrame, grid: Grid, method: str, by: list[str], value: str = "value", least: float | None = None, order: str | None = None) -> DataFrame:
    """by, row, col, value, n. method: mean, weighted (by the inverse square distance from the centre) or nearest.

    Values under ``least`` don't count. One aggregation with map-side partials;
    nearest keeps one row a cell and task.
    """
    v = F.col(value) if least is None else F.when(F.col(value) >= least, F.col(value))
    cells = to_cells(points, grid).withColumn("__v", v).filter("__v is not null")
    d2 = grid.offset(F.col("lon"), F.col("lat"), F.col("col"), F.col("row"))
    weight = 1 / F.greatest(d2, F.lit(1e-6))
    how = {
        "mean": lambda: F.avg("__v"),
        "weighted": lambda: F.sum(F.col("__v") * weight) / F.sum(weight),
        "nearest": lambda: F.min_by("__v", F.struct(d2, *([F.col(order)] if order else []))),
    }[method]
    return cells.groupBy(*by, "row", "col").agg(how().alias(value), F.count("*").alias("n"))


def reaggregate(cells: DataFrame, ts: str, period: str, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Means of cell means: period none, daily or all. n adds up."""
    if period == "none":
        return cells
    keys = [*(by or []), "row", "col"]
    if period == "daily":
        return cells.groupBy(F.date_trunc("day", ts).alias(ts), *keys).agg(F.avg(value).alias(value), F.sum("n").alias("n"))
    return cells.groupBy(*keys).agg(F.avg(value).alias(value), F.sum("n").alias("n"))


def densify(cells: DataFrame, grid: Grid, times: DataFrame, ts: str, value: str = "value", scale: float = 1.0, missing: float = -9.999e36) -> DataFrame:
    """Every cell of every time; absent ones get the missing value. For sinks. Each time makes the grid's cells itself, so nothing is joined with all times."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(grid.rows * grid.cols - 1)))
    every = times.select(ts).distinct().select(ts, cell.alias("__cell"))
    every = every.select(ts, F.floor(F.col("__cell") / grid.cols).cast("int").alias("row"), (F.col("__cell") % grid.cols).cast("int").alias("col"))
    return every.join(cells, [ts, "row", "col"], "left").withColumn(value, F.coalesce(F.col(value) * scale, F.lit(missing)))


def notes(col: Column, size: int = 255) -> Column:
    """Distinct notes in order, joined by commas, cut to a size; an aggregate."""
    return F.left(F.array_join(F.array_sort(F.collect_set(col)), ","), F.lit(size))


def quads_to_cells(quads: DataFrame, grid: Grid) -> DataFrame:
    """quads with row, col and the share of each quad's area in that cell.

    quads: x1, y1 … x4, y4 (corners in order, convex), in grid coordinates after
    projection. Cells under the quad's box are exploded; Arrow batches of (quad,
    cell) rows are clipped by the cell's four half-planes at once.
    """
    xs, ys = [F.col(f"x{i}") for i in range(1, 5)], [F.col(f"y{i}") for i in range(1, 5)]
    lo = lambda cs, o, d, n: F.greatest(F.lit(0), F.floor((F.least(*cs) - o) / d)).cast("int")
    hi = lambda cs, o, d, n: F.least(F.lit(n - 1), F.floor((F.greatest(*cs) - o) / d)).cast("int")
    span = lambda cs, o, d, n: F.when(lo(cs, o, d, n) <= hi(cs, o, d, n), F.sequence(lo(cs, o, d, n), hi(cs, o, d, n)))
    out = quads.withColumn("col", F.explode(span(xs, grid.west, grid.dx, grid.cols))).withColumn("row", F.explode(span(ys, grid.south, grid.dy, grid.rows)))
    west, south, dx, dy = grid.west, grid.south, grid.dx, grid.dy

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.stack([b[f"{a}{i}"].to_numpy(zero_copy_only=False) for i in range(1, 5)], 1).astype(float) if len(b) else np.zeros((0, 4)) for a in "xy")
            left, low = (b[c].to_numpy(zero_copy_only=False) * d + o for c, d, o in (("col", dx, west), ("row", dy, south)))
            share = _shares(x, y, left, low, dx, dy)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(share, pa.float64())], names=[*b.schema.names, "share"])

    schema = T.StructType([*out.schema.fields, T.StructField("share", T.DoubleType())])
    return out.mapInArrow(shares, schema).filter("share > 0")


def _areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed area of each row's ring."""
    return (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) / 2


def _clip(x: np.ndarray, y: np.ndarray, axis: int, bound: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each ring on the bound's side. A vertex that falls away becomes its predecessor, which leaves the area as it is."""
    depth = ((x, y)[axis] - bound) * sign
    inside, ahead = depth >= 0, np.roll(depth, -1, 1)
    crosses = inside != (ahead >= 0)
    t = np.where(crosses, depth / np.where(crosses, depth - ahead, 1), 0)
    n = x.shape[1] * 2
    keep = np.stack((inside, crosses), 2).reshape(-1, n)
    at = np.maximum.accumulate(np.where(keep, np.arange(n), -1), 1)
    at = np.where(at < 0, keep.argmax(1)[:, None] if n else at, at)
    none = ~keep.any(1)
    both = []
    for k, v in enumerate((x, y)):
        # a new vertex lies on the bound itself, without the error of t
        cut = np.broadcast_to(bound, v.shape) if k == axis else v + t * (np.roll(v, -1, 1) - v)
        new = np.stack((v, cut), 2).reshape(-1, n)
        new = np.take_along_axis(new, at, 1)
        new[none] = np.nan
        both.append(new)
    return both[0], both[1]


#: Quads that a task merges at a time, and (quad, cell) pairs that it clips at a time.
MERGED, CLIPPED = 200_000, 500_000


def regrid_quads(quads: DataFrame, grid: Grid, by: list[str], value: str = "value") -> DataFrame:
    """by, row, col, value (mean weighted by share of area), weight, n.

    quads as for quads_to_cells. Only the keys, corners and values go through
    Arrow, a row a quad; equal quads of a task are merged before they are clipped, and
    Spark adds up what tasks find for a cell.
    """
    names = [f"{a}{i}" for i in range(1, 5) for a in "xy"]

    def clipped(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.group_by([*by, *names]).aggregate([("__v", "sum"), ("__v", "count")])
        x, y = (np.stack([t[f"{a}{i}"].to_numpy() for i in range(1, 5)], 1) for a in "xy")
        ends = []
        for v, o, d, n in ((x, grid.west, grid.dx, grid.cols), (y, grid.south, grid.dy, grid.rows)):
            ends.append(np.clip(np.floor((v.min(1) - o) / d), 0, n).astype(np.int64))
            ends.append(np.clip(np.floor((v.max(1) - o) / d), -1, n - 1).astype(np.int64))
        wide, high = np.maximum(ends[1] - ends[0] + 1, 0), np.maximum(ends[3] - ends[2] + 1, 0)
        upto = np.cumsum(wide * high)
        at = 0
        while at < len(upto):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CLIPPED, "right")))
            size = (wide * high)[at:end]
            q = np.repeat(np.arange(at, at + len(size)), size)
            k = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
            col, row = ends[0][q] + k % np.maximum(wide[q], 1), ends[2][q] + k // np.maximum(wide[q], 1)
            share = _shares(x[q], y[q], col * grid.dx + grid.west, row * grid.dy + grid.south, grid.dx, grid.dy)
            use = np.flatnonzero(share > 0)
            q, row, col, share = q[use], row[use], col[use], share[use]
            total, n = t["__v_sum"].to_numpy()[q], t["__v_count"].to_numpy()[q]
            keys = [t[c].combine_chunks().take(pa.array(q)) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(total * share), pa.array(n * share), pa.array(n, pa.int64())], names=[*by, "row", "col", "__vs", "__s", "__n"])
            at = end

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= MERGED:
                yield from clipped(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from clipped(pa.Table.from_batches(held))

    rows = quads.select(*by, *[F.col(c).cast("double").alias(c) for c in names], F.col(value).cast("double").alias("__v")).filter("__v is not null").dropna(subset=names)
    kinds = [("row", T.IntegerType()), ("col", T.IntegerType()), ("__vs", T.DoubleType()), ("__s", T.DoubleType()), ("__n", T.LongType())]
    out = rows.mapInArrow(parts, T.StructType([*[rows.schema[c] for c in by], *[T.StructField(n, k) for n, k in kinds]]))
    return out.groupBy(*by, "row", "col").agg((F.sum("__vs") / F.sum("__s")).alias(value), F.sum("__s").alias("weight"), F.sum("__n").alias("n"))


def _shares(x: np.ndarray, y: np.ndarray, left: np.ndarray, low: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Share of each ring's area that lies in its cell."""
    whole = np.abs(_areas(x, y))
    left, low = left[:, None], low[:, None]
    for axis, bound, sign in ((0, left, 1), (0, left + dx, -1), (1, low, 1), (1, low + dy, -1)):
        x, y = _clip(x, y, axis, bound, sign)
    return np.abs(np.nan_to_num(_areas(x, y))) / np.where(whole > 0, whole, np.inf)


def corners(centres: DataFrame, by: list[str]) -> DataFrame:
    """Corner between each cell and its east, north and north-east neighbours: the mean of those there are."""
    pad = centres.select(*by, "row", "col", "lon", "lat")
    moved = None
    for dr in (0, 1):
        for dc in (0, 1):
            m = pad.withColumn("row", F.col("row") - dr).withColumn("col", F.col("col") - dc)
            moved = m if moved is None else moved.unionByName(m)
    out = moved.groupBy(*by, "row", "col").agg(F.avg("lon").alias("corner_lon"), F.avg("lat").alias("corner_lat"), F.count("*").alias("n"))
    return out.filter("n = 4").drop("n")


def _corner_weights(at: str, size: Column) -> Column:
    """Array of (k, w): the corners that a centre counts in along one direction. An inner corner is the mean of two centres; an outer one goes on from the last two in a line."""
    x = F.col(at)
    pair = lambda k, w: F.struct(k.cast("int").alias("k"), w.alias("w"))
    own = [pair(x, F.when(x == 0, 1.5).otherwise(0.5)), pair(x + 1, F.when(x == size - 1, 1.5).otherwise(0.5))]
    far = [pair(F.when(x == 1, F.lit(0)), F.lit(-0.5)), pair(F.when(x == size - 2, size), F.lit(-0.5))]
    return F.filter(F.array(*own, *far), lambda p: p["k"].isNotNull())


def swath_corners(centres: DataFrame, by: list[str], rows: int | None = None, cols: int | None = None) -> DataFrame:
    """by, row, col, corner_lon, corner_lat: all rows + 1 by cols + 1 corners of swaths of centres (row, col from 0, lon, lat).

    Corners at the edges are extrapolated linearly; longitudes across the date line are
    taken on one side of it and come back within -180 to 180. A corner needs its four
    centres (at an edge, the two beside it and the two behind those); a swath of one row
    or column has none. rows, cols: the swaths' shape, else each one's largest row and
    column. A centre adds to nine corners at most, with sums in the task first.
    """
    if (rows is None or cols is None) and by:
        sized = centres.join(centres.groupBy(*by).agg((F.max("row") + 1).alias("__rows"), (F.max("col") + 1).alias("__cols")), by)
    else:
        if rows is None or cols is None:
            rows, cols = centres.agg(F.max("row") + 1, F.max("col") + 1).first()
        sized = centres.withColumns({"__rows": F.lit(rows), "__cols": F.lit(cols)})
    sized = sized.filter("__rows > 1 and __cols > 1 and lon is not null and lat is not null")
    dealt = sized.select(*by, "lon", "lat", F.explode(_corner_weights("row", F.col("__rows"))).alias("__r"), _corner_weights("col", F.col("__cols")).alias("__cs"))
    dealt = dealt.select(*by, "lon", "lat", "__r", F.explode("__cs").alias("__c"))
    w = F.col("__r.w") * F.col("__c.w")
    east = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))
    out = dealt.groupBy(*by, F.col("__r.k").alias("row"), F.col("__c.k").alias("col")).agg(F.sum(w * F.col("lon")).alias("__a"), F.sum(w * east).alias("__b"), (F.max("lon") - F.min("lon")).alias("__span"), F.sum(w * F.col("lat")).alias("corner_lat"), F.count("*").alias("__n"))
    lon = F.when(F.col("__span") > 180, F.col("__b")).otherwise(F.col("__a"))
    return out.filter("__n = 4").select(*by, "row", "col", (F.pmod(lon + 180, F.lit(360.0)) - 180).alias("corner_lon"), "corner_lat")


def corner_quads(corners: DataFrame, by: list[str]) -> DataFrame:
    """by, row, col, x1, y1 .. x4, y4: the four corners of each cell, around it, for regrid_quads; longitudes of a cell across the date line go on beyond 180."""
    order = [(0, 0), (0, 1), (1, 1), (1, 0)]
    cells = F.array(*[F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.lit(k).alias("k")) for k, (r, c) in enumerate(order, 1)])
    dealt = corners.select(*by, F.explode(cells).alias("__c"), "corner_lon", "corner_lat").select(*by, "__c.*", "corner_lon", "corner_lat")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = dealt.groupBy(*by, "row", "col").agg(*[e for k in range(1, 5) for e in (pick("corner_lon", k).alias(f"x{k}"), pick("corner_lat", k).alias(f"y{k}"))], F.count("*").alias("__n")).filter("__n = 4")
    xs = [F.col(f"x{k}") for k in range(1, 5)]
    wide = F.greatest(*xs) - F.least(*xs) > 180
    return out.select(*by, "row", "col", *[e for k in range(1, 5) for e in (F.when(wide & (F.col(f"x{k}") < 0), F.col(f"x{k}") + 360).otherwise(F.col(f"x{k}")).alias(f"x{k}"), F.col(f"y{k}"))])


def by_window(profiles: DataFrame, window: int, levels: int, target: int, by: list[str]) -> DataFrame:
    """Along-track means of so many points, and of levels down to a target number."""
    k = F.floor(F.col("point") / window).cast("int")
    level = F.floor(F.col("level") * target / levels).cast("int")
    return profiles.groupBy(*by, k.alias("point"), level.alias("level")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def running(by: list[str], hour: str, hours: int) -> W:
    """The frame of an hour and the hours - 1 after it."""
    return W.partitionBy(*by).orderBy(hour).rangeBetween(0, hours - 1)


def daily_max8(hourly: DataFrame, by: list[str], hour: str = "hour", value: str = "value", least: int = 6) -> DataFrame:
    """by, day, value: the day's largest mean over eight hours with at least so many valid hours. hour: hours since 1970."""
    w = running(by, hour, 8)
    mean8 = F.when(F.count(value).over(w) >= least, F.avg(value).over(w))
    return hourly.withColumn("__m", mean8).groupBy(*by, F.floor(F.col(hour) / 24).cast("long").alias("day")).agg(F.max("__m").alias(value)).filter(F.col(value).isNotNull())


def forward_fill(df: DataFrame, valid: Column, column: str, by: list[str], order: list[str]) -> DataFrame:
    """Invalid values become the last valid one before them; those before the first become null."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.when(valid, F.col(column)), ignorenulls=True).over(w))


def first_of_run(df: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows at which a column differs from the row before."""
    before = F.lag(column).over(W.partitionBy(*by).orderBy(*order))
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__new", (n == 1) | ~F.col(column).eqNullSafe(before)).filter("__new").drop("__new")


def running_total(rows: DataFrame, key: str, n: str, width: int, name: str = "total") -> DataFrame:
    """rows with the sum of n up to their key, which is a different whole number in each: summed by bins of so many keys first, so no task has all rows."""
    rows = rows.withColumn("__bin", F.floor(F.col(key) / width).cast("long"))
    before = W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # one row a bin
    bins = rows.groupBy("__bin").agg(F.sum(n).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = F.sum(n).over(W.partitionBy("__bin").orderBy(key))
    return rows.join(bins, "__bin").withColumn(name, F.col("__before") + inside).drop("__bin", "__before")
