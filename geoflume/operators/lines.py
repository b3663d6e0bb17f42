"""Nearest polylines without a reach, and polylines clipped to a box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflume.operators import joins as J
from geoflume.operators.exact import checkpointed


def segments(lines: DataFrame) -> DataFrame:
    """fid, x1, y1, x2, y2 of each step of lines (fid, xs, ys); a line of one vertex is a point."""
    at = F.sequence(F.lit(0), F.greatest(F.size("xs") - 2, F.lit(0)))
    rows = lines.filter("size(xs) > 0 and size(xs) = size(ys)").select("fid", "xs", "ys", F.explode(at).alias("i"))
    end = F.least(F.col("i") + 1, F.size("xs") - 1)
    rows = rows.select("fid", F.get("xs", F.col("i")).alias("x1"), F.get("ys", F.col("i")).alias("y1"), F.get("xs", end).alias("x2"), F.get("ys", end).alias("y2"))
    return rows.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def distance_to_segment(lon: Column, lat: Column) -> Column:
    """From a place to the segment x1, y1, x2, y2 of the row, in the plane."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - F.col("x1")) * dx + (lat - F.col("y1")) * dy) / square))).otherwise(0.0)
    x, y = lon - (F.col("x1") + t * dx), lat - (F.col("y1") + t * dy)
    return F.sqrt(x * x + y * y)


def cells_crossed(parts: DataFrame, size: float) -> DataFrame:
    """parts (x1, y1, x2, y2) for each cell __x, __y of a size that the segment passes: at most its columns and rows together."""
    cut = lambda c: F.floor(c / size).cast("long")
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    out = parts.withColumn("__x", F.explode(F.sequence(cut(F.least(x1, x2)), cut(F.greatest(x1, x2)))))
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (x - x1) * (y2 - y1) / F.when(x1 != x2, x2 - x1))
    low, high = at(F.greatest(F.least(x1, x2), F.col("__x") * size)), at(F.least(F.greatest(x1, x2), (F.col("__x") + 1) * size))
    # a vertical segment has its whole length in its column; rounding may take a hair, and a hair more does no harm
    low, high = (F.when(x1 == x2, f(y1, y2)).otherwise(f(low, high)) for f in (F.least, F.greatest))
    return out.withColumn("__y", F.explode(F.sequence(cut(low - size * 1e-6), cut(high + size * 1e-6))))


def nearest_line(points: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """Each point (lon, lat) with fid and distance of the nearest line (fid, xs, ys), however far; the lesser fid on ties. Points keep their rows; without lines, or for a null place, both are null.

    Rings of doubling cells, exact (joins.by_rings), the last so large that nine hold
    all. A segment is dealt to the cells that it passes. The first size is ``cell``
    times the power of two with the fewest rows: small cells cut segments in many
    parts, large ones have many segments around a place. A place is searched once,
    however many points stand there, and so is a segment: of equal ones, the least fid.
    """
    parts = J.spread_out(segments(lines).groupBy("x1", "y1", "x2", "y2").agg(F.min("fid").alias("fid")))
    places = checkpointed(points.select("lon", "lat").filter("lon is not null and lat is not null").distinct())
    both = parts.select(F.least("x1", "x2").alias("x0"), F.greatest("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y0"), F.greatest("y1", "y2").alias("y1"), F.lit(1).alias("part"))
    both = both.union(places.select("lon", "lon", "lat", "lat", F.lit(0)))
    r = both.agg(F.sum("part").alias("n"), F.count_if(F.col("part") == 0).alias("places"), F.sum(F.col("part") * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))).alias("length"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h")).first()
    if not r.n or not r.places:
        return points.select("*", F.lit(None).cast(lines.schema["fid"].dataType).alias("fid"), F.lit(None).cast("double").alias("distance"))
    last = max(0, math.ceil(math.log2(max(r.w, r.h, cell) / cell)))

    def rows(k: int) -> float:
        size = cell * 2.0**k
        passed = r.length / size + r.n
        moved = passed if r.places <= J.HELD_PLACES else 8 * passed  # shuffled and sorted by cell
        return moved + passed * 9 * r.places * min(1.0, size * size / (max(r.w, size) * max(r.h, size)))

    first = min(range(-20, last + 1), key=rows)
    found = J.by_rings(places, lambda size: cells_crossed(parts, size), distance_to_segment(F.col("lon"), F.col("lat")), [cell * 2.0**k for k in range(first, last + 1)])
    return points.join(found, ["lon", "lat"], "left").select(*points.columns, "fid", "distance")


def clipped(lines: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """fid, piece, x1, y1, x2, y2: what lies in the box (both ends count) of each segment of lines, by the segment's place; segments outside go.

    A segment is the places at t of 0 to 1; each side of the box bounds t from below
    where the segment enters by it and from above where it leaves.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size("xs") - 2, F.lit(0)))
    rows = lines.filter("size(xs) > 1 and size(xs) = size(ys)").select("fid", "xs", "ys", F.explode(at).alias("piece"))
    i = F.col("piece")
    rows = rows.select("fid", "piece", F.get("xs", i).alias("x"), F.get("ys", i).alias("y"), (F.get("xs", i + 1) - F.get("xs", i)).alias("dx"), (F.get("ys", i + 1) - F.get("ys", i)).alias("dy"))
    enter, leave, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, d, low, high in (("x", "dx", west, east), ("y", "dy", south, north)):
        p, d = F.col(p), F.col(d)
        a, b = (F.lit(low) - p) / F.when(d != 0, d), (F.lit(high) - p) / F.when(d != 0, d)
        enter.append(F.least(a, b))
        leave.append(F.greatest(a, b))
        ok = ok & ((d != 0) | p.between(low, high))
    rows = rows.withColumns({"t0": F.greatest(*enter), "t1": F.least(*leave)}).filter(ok & (F.col("t0") <= F.col("t1")))
    place = lambda c, t: F.col(c) + F.col(t) * F.col(f"d{c}")
    return rows.select("fid", "piece", place("x", "t0").alias("x1"), place("y", "t0").alias("y1"), place("x", "t1").alias("x2"), place("y", "t1").alias("y2"))
