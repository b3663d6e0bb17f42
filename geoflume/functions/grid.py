"""Grids: cells of points, centres of cells, vertical layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.functions.projection import LonLat


@dataclass(frozen=True)
class Grid:
    cols: int
    rows: int
    west: float
    south: float
    dx: float
    dy: float
    projection: object = field(default_factory=LonLat)

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Column and row, from 0, or nulls outside the grid."""
        x, y = self.projection.project(lon, lat)
        col, row = (F.floor((x - self.west) / self.dx), F.floor((y - self.south) / self.dy))
        inside = col.between(0, self.cols - 1) & row.between(0, self.rows - 1)
        return F.when(inside, col).cast("int"), F.when(inside, row).cast("int")

    def centre(self, col: Column, row: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a cell's centre."""
        return self.projection.unproject((col + 0.5) * self.dx + self.west, (row + 0.5) * self.dy + self.south)

    def offset(self, lon: Column, lat: Column, col: Column, row: Column) -> Column:
        """Squared distance of a point from its cell's centre, in cells."""
        x, y = self.projection.project(lon, lat)
        ox, oy = (x - self.west) / self.dx - col - 0.5, (y - self.south) / self.dy - row - 0.5
        return ox * ox + oy * oy

    def frame(self, spark: SparkSession) -> DataFrame:
        """Every cell: row, col."""
        return spark.range(self.cols * self.rows).select(F.floor(F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))


def layer_of(elevation: Column, edges: list[float]) -> Column:
    """Layer, from 0, whose edges hold the elevation (lower edge counted); null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((elevation >= edges[i - 1]) & (elevation < edges[i]), F.lit(i - 1)).otherwise(out)
    return out


def sigma_height(sigma: Column, top: float, surface_pressure: float = 1e5, g: float = 9.81, gas: float = 287.04, lapse: float = 50.0, t0: float = 290.0) -> Column:
    """Height in metres of a sigma-pressure level in the reference atmosphere with temperature t0 + lapse * ln(p / p0)."""
    p = sigma * (surface_pressure - top) + top
    z = F.log(p / surface_pressure)
    return -(z * z * (gas * lapse / (2 * g)) + z * (gas * t0 / g))


def height_sigma(height: Column, top: float, surface_pressure: float = 1e5, g: float = 9.81, gas: float = 287.04, lapse: float = 50.0, t0: float = 290.0) -> Column:
    """Inverse of sigma_height."""
    root = F.sqrt(F.greatest(F.lit(0.0), t0 * t0 - height * (2 * lapse * g / gas)))
    p = F.exp((root - t0) / lapse) * surface_pressure
    return (p - top) / (surface_pressure - top)


def morton(lon: Column, lat: Column, bits: int = 12) -> Column:
    """Z-order key of a point, for clustering files so that boxes prune row groups."""
    x = F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((lon + 180) / 360 * 2**bits))).cast("long")
    y = F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((lat + 90) / 180 * 2**bits))).cast("long")
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(1), 2 * i + 1))
    return out


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes (west, south, east, north) share a point, edges counted."""
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def valid_lon(lon: Column) -> Column:
    return lon.between(-180, 180)


def valid_lat(lat: Column) -> Column:
    return lat.between(-90, 90)


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area of a polygon ring by the shoelace sum; counter-clockwise is positive."""
    nx = F.concat(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, 1))
    ny = F.concat(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, 1, 1))
    cross = F.zip_with(F.arrays_zip(xs.alias("x"), ys.alias("y")), F.arrays_zip(nx.alias("x"), ny.alias("y")), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2


def circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * 6371.0088)


def ordered_bounds(west: Column, south: Column, east: Column, north: Column) -> dict[str, Column]:
    """Bounds with their ends in order; all of the globe where one of them is missing or none of its places is one."""
    bad = ~F.coalesce(valid_lon(west) & valid_lon(east) & valid_lat(south) & valid_lat(north), F.lit(False))
    ends = {"west": (F.least(west, east), -180.0), "south": (F.least(south, north), -90.0), "east": (F.greatest(west, east), 180.0), "north": (F.greatest(south, north), 90.0)}
    return {k: F.when(bad, F.lit(full)).otherwise(v) for k, (v, full) in ends.items()}


def clamped(lon: Column, neighbour: Column) -> Column:
    """A longitude on its neighbour's side of the date line: at the line if the two are over 180 degrees apart."""
    return F.when(F.abs(lon - neighbour) > 180, F.when(neighbour < 0, -180.0).otherwise(180.0)).otherwise(lon)


def subsumes(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether box a holds all of box b."""
    return (a["west"] <= b["west"]) & (a["east"] >= b["east"]) & (a["south"] <= b["south"]) & (a["north"] >= b["north"])


#: Squared ratio of the semi-axes of WGS 84. Fixed value.
WGS84_RATIO = (6356752.314245179 / 6378137.0) ** 2


def geocentric(lat: Column) -> Column:
    """Latitude on a sphere of a geodetic one on WGS 84."""
    return F.degrees(F.atan(F.tan(F.radians(lat)) * WGS84_RATIO))


def geodetic(lat: Column) -> Column:
    """Inverse of geocentric."""
    return F.degrees(F.atan(F.tan(F.radians(lat)) / WGS84_RATIO))


def perimeter(xs: Column, ys: Column) -> Column:
    """Length of a closed ring."""
    nx, ny = F.concat(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1)), F.concat(F.slice(ys, 2, F.size(ys)), F.slice(ys, 1, 1))
    sides = F.zip_with(F.arrays_zip(xs.alias("x"), ys.alias("y")), F.arrays_zip(nx.alias("x"), ny.alias("y")), lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(sides, F.lit(0.0), lambda a, c: a + c)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size > 0, ((x - x1) * dx + (y - y1) * dy) / size).otherwise(0.0)))
    ox, oy = x - x1 - t * dx, y - y1 - t * dy
    return F.sqrt(ox * ox + oy * oy)
