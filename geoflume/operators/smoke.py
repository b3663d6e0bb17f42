"""Fires and smoke: points in polygons while these last, and the names of their codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflume.operators.joins import _level, _levels, _node, in_blocks, small

#: Ecosystems of fire points by code, from 1. Fixed values.
ECOSYSTEMS = (
    "Urban", "Low Sparse Grassland", "Coniferous Forest", "Deciduous Conifer Forest", "Deciduous Broadleaf Forest", "Evergreen Broadleaf Forests", "Tall Grasses and Shrubs", "Bare Desert", "Upland Tundra", "Irrigated Grassland",
    "Semi Desert", "Glacier Ice", "Wooded Wet Swamp", "Inland Water", "Sea Water", "Shrub Evergreen", "Shrub Deciduous", "Mixed Forest and Field", "Evergreen Forest and Fields", "Cool Rain Forest",
    "Conifer Boreal Forest", "Cool Conifer Forest", "Cool Mixed Forest", "Mixed Forest", "Cool Broadleaf Forest", "Deciduous Broadleaf Forest", "Conifer Forest", "Montane Tropical Forests", "Seasonal Tropical Forest", "Cool Crops and Towns",
    "Crops and Town", "Dry Tropical Woods", "Tropical Rainforest", "Tropical Degraded Forest", "Corn and Beans Cropland", "Rice Paddy and Field", "Hot Irrigated Cropland", "Cool Irrigated Cropland", "Cold Irrigated Cropland", "Cool Grasses and Shrubs",
    "Hot and Mild Grasses and Shrubs", "Cold Grassland", "Savanna (Woods)", "Mire, Bog, Fen", "Marsh Wetland", "Mediterranean Scrub", "Dry Woody Scrub", "Dry Evergreen Woods", "Volcanic Rock", "Sand Desert",
    "Semi Desert Shrubs", "Semi Desert Sage", "Barren Tundra", "Cool Southern Hemisphere Mixed Forests", "Cool Fields and Woods", "Forest and Field", "Cool Forest and Field", "Fields and Woody Savanna", "Succulent and Thorn Scrub", "Small Leaf Mixed Woods",
    "Deciduous and Mixed Boreal Forest", "Narrow Conifers", "Wooded Tundra", "Heath Scrub", "Coastal Wetland, NW", "Coastal Wetland, NE", "Coastal Wetland, SE", "Coastal Wetland, SW", "Polar and Alpine Desert", "Glacier Rock",
    "Salt Playas", "Mangrove", "Water and Island Fringe",
)


def ecosystem(code: Column) -> Column:
    """The name of a code; null for an unknown one."""
    return F.get(F.array(*map(F.lit, ECOSYSTEMS)), code.cast("int") - 1)


def fire_time(yearday: Column, hhmm: Column) -> Column:
    """A timestamp from a whole yyyyddd and a whole hhmm; null if they are none."""
    day = F.try_to_date(F.lpad(yearday.cast("string"), 7, "0"), "yyyyDDD")
    fits = (hhmm >= 0) & (F.floor(hhmm / 100) < 24) & (hhmm % 100 < 60)
    return F.when(fits, day.cast("timestamp") + F.make_dt_interval(hours=F.floor(hhmm / 100).cast("int"), mins=(hhmm % 100).cast("int")))


def smoke_span(day: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The timestamps of whole hhmm Start and End of a day's file; an End before its Start is on the day after."""
    at = lambda h: day.cast("timestamp") + F.make_dt_interval(hours=F.floor(h / 100).cast("int"), mins=(h % 100).cast("int"))
    return at(start), F.when(end < start, at(end) + F.expr("INTERVAL 1 DAY")).otherwise(at(end))


def _edges() -> Column:
    """x1, y1, x2, y2 of each side of each ring."""

    def sides(r: Column) -> Column:
        xs, ys, n = r.getField("xs"), r.getField("ys"), F.size(r.getField("xs"))
        at = lambda i: F.struct(F.get(xs, i).alias("x1"), F.get(ys, i).alias("y1"), F.get(xs, (i + 1) % n).alias("x2"), F.get(ys, (i + 1) % n).alias("y2"))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.flatten(F.transform(F.filter("rings", lambda r: F.size(r.getField("xs")) > 2), sides))


#: Events of one place and period in one row.
CHUNK = 1024


def _chunks(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and an array of structs of the other columns, of CHUNK rows or so; a group of more is dealt to several by the hash of its rows."""
    rest = [c for c in points.columns if c not in keys]
    heavy = small(points.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > CHUNK).select(*[F.col(c).alias(f"__of_{c}") for c in keys], F.ceil(F.col("__n") / CHUNK).alias("__n")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys])
    dealt = points.join(heavy, same, "left").withColumn("__chunk", F.pmod(F.xxhash64(*rest), F.coalesce("__n", F.lit(1))))
    return dealt.groupBy(*keys, "__chunk").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__chunk")


def in_polygons_during(points: DataFrame, polygons: DataFrame, cell: float = 1.0, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Points (lon, lat, ts) with the columns of each polygon that holds them while it lasts: id, start, end (both ends count; null: open) and others, without rings.

    polygons: rings is an array of structs of arrays xs, ys; the even-odd rule counts
    over all rings, so later ones may be holes or further parts. Points of one place
    and period of eight times ``minutes`` go together. A polygon is dealt by the size
    of its box and the length of its time to a level of doubling cells and of doubling
    periods, to nine cells and five periods at most, however large it is; points to
    their one cell and period of each level in use. What meets there is held against
    the box first, then the rule decides in expressions, once a place and period, and
    the times of its points at last.
    """
    cut = lambda c, by: F.floor(c / by).cast("long")
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    period = minutes * 60 * 8
    shapes = polygons.withColumn("__edges", _edges()).filter(F.size("__edges") > 0).drop("rings")
    low, high = (lambda f: F.transform("__edges", lambda e: e.getField(f))), F.array_max
    shapes = shapes.withColumns({"__west": F.array_min(low("x1")), "__east": high(low("x1")), "__south": F.array_min(low("y1")), "__north": high(low("y1"))})
    shapes = shapes.withColumns({"__x0": cut(F.col("__west"), cell), "__x1": cut(F.col("__east"), cell), "__y0": cut(F.col("__south"), cell), "__y1": cut(F.col("__north"), cell)})
    shapes = shapes.withColumns({"__t0": cut(secs("start"), period), "__t1": cut(secs("end"), period)})
    open_ = F.col("__t0").isNull() | F.col("__t1").isNull()
    finer = lambda length, k: F.greatest(F.lit(0), _level(length) - k)
    shapes = shapes.withColumn("__level", finer(F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")) + 1, 1))
    shapes = shapes.withColumn("__tl", F.when(open_, F.lit(62)).otherwise(finer(F.col("__t1") - F.col("__t0") + 1, 2))).filter(open_ | (F.col("__t0") <= F.col("__t1")))
    [places], [times] = _levels(shapes), _levels(shapes.select(F.col("__tl").alias("__level")))
    for c, level in (("x", "__level"), ("y", "__level"), ("t", "__tl")):
        first, last = (_node(F.coalesce(F.col(f"__{c}{k}"), F.lit(0)), F.col(level)) for k in (0, 1))
        shapes = shapes.withColumn(f"__{c}", F.explode(F.sequence(first, last)))
    shapes = shapes.drop("__x0", "__x1", "__y0", "__y1", "__t0", "__t1")
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    points_ = points.filter("lon is not null and lat is not null").withColumn("__period", cut(secs(ts), period))
    spread = _chunks(points_, ["lon", "lat", "__period"], "__points")
    spread = spread.withColumn("__level", F.explode(ints(places))).withColumn("__tl", F.explode(ints(times)))
    spread = spread.withColumns({"__x": _node(cut(F.col("lon"), cell), F.col("__level")), "__y": _node(cut(F.col("lat"), cell), F.col("__level")), "__t": _node(F.col("__period"), F.col("__tl"))}).drop("__period")
    near = in_blocks(spread, shapes, ["__level", "__tl", "__x", "__y", "__t"])
    lon, lat = F.col("lon"), F.col("lat")
    near = near.filter(lon.between(F.col("__west"), F.col("__east")) & lat.between(F.col("__south"), F.col("__north")))

    def crosses(e: Column) -> Column:
        up = (e.getField("y1") > lat) != (e.getField("y2") > lat)
        x = e.getField("x1") + (lat - e.getField("y1")) * (e.getField("x2") - e.getField("x1")) / F.when(e.getField("y2") == e.getField("y1"), 1.0).otherwise(e.getField("y2") - e.getField("y1"))
        return up & (lon < x)

    inside = F.size(F.filter("__edges", crosses)) % 2 == 1
    kept = [c for c in polygons.columns if c != "rings"]
    held = near.filter(inside).select("lon", "lat", *kept, F.explode("__points").alias("__point"))
    at = F.col(f"__point.{ts}")
    held = held.filter((F.col("start").isNull() | (at >= F.col("start"))) & (F.col("end").isNull() | (at <= F.col("end"))))
    return held.select(*[c if c in ("lon", "lat") else F.col(f"__point.{c}").alias(c) for c in points.columns], *kept)
