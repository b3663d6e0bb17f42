"""Sinks in text formats: each gives a DataFrame of lines or writes with Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflume.functions.text import general


def sheet(df: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Columns named name(units), for a tab-separated sheet."""
    return df.toDF(*[f"{c}({(units or {}).get(c, '-')})" for c in df.columns])


def write_sheet(df: DataFrame, path: str, units: dict[str, str] | None = None, compress: bool = False) -> None:
    sheet(df, units).write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def kml_points(df: DataFrame, name: str, value: str) -> DataFrame:
    """A Placemark line for each point (lon, lat, name, value)."""
    shape = "<Placemark><name>%s</name><description>%s</description><Point><coordinates>%.6f,%.6f</coordinates></Point></Placemark>"
    clean = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return df.select(F.format_string(shape, clean(name), clean(value), "lon", "lat").alias("line"))


def kml_polygons(df: DataFrame, name: str, value: str) -> DataFrame:
    """A Placemark line for each row of rings (structs of arrays xs, ys; the first is the outer one, the others holes); rings are closed."""
    at = lambda r, i: F.format_string("%.6f,%.6f", F.get(r["xs"], i), F.get(r["ys"], i))
    ring = lambda r: F.concat(F.lit("<LinearRing><coordinates>"), F.array_join(F.transform(F.concat(F.sequence(F.lit(0), F.size(r["xs"]) - 1), F.array(F.lit(0))), lambda i: at(r, i)), " "), F.lit("</coordinates></LinearRing>"))
    side = lambda r, i: F.concat(F.when(i == 0, "<outerBoundaryIs>").otherwise("<innerBoundaryIs>"), ring(r), F.when(i == 0, "</outerBoundaryIs>").otherwise("</innerBoundaryIs>"))
    clean = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    sides = F.array_join(F.transform(F.filter("rings", lambda r: F.size(r["xs"]) > 2), side), "")
    return df.select(F.format_string("<Placemark><name>%s</name><description>%s</description><Polygon>%s</Polygon></Placemark>", clean(name), clean(value), sides).alias("line"))


def geojson(df: DataFrame, *properties: str) -> DataFrame:
    """A Feature line for each point."""
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(shape).alias("line"))


def capabilities(catalog: DataFrame) -> DataFrame:
    """A CoverageOfferingBrief line for each product and variable."""
    shape = "<CoverageOfferingBrief><name>%s.%s</name><label>%s(%s)</label></CoverageOfferingBrief>"
    return catalog.select(F.format_string(shape, "product", "variable", "variable", "units").alias("line"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def extents(points: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """by, west, south, east, north, first, last of the points with a place and a time: what a description tells."""
    rows = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(by).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def descriptions(coverages: DataFrame, step: str = "PT1H", missing: float = -9999.0) -> DataFrame:
    """A CoverageOffering line for each variable, units, description and extent (see extents); bounds with two decimals, times to the second."""
    name, units, about = (_escaped(F.coalesce(c, F.lit(""))) for c in ("variable", "units", "description"))
    corner = lambda x, y: F.format_string("<gml:pos>%.2f %.2f</gml:pos>", F.col(x), F.col(y))
    time = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f"</{tag}>"))
    label = F.concat(F.lit("<name>"), name, F.lit("</name><label>"), name, F.lit("("), units, F.lit(")</label><description>"), about, F.lit("</description>"))
    space = F.concat(F.lit('<spatialDomain><gml:Envelope srsName="WGS84(DD)">'), corner("west", "south"), corner("east", "north"), F.lit("</gml:Envelope></spatialDomain>"))
    period = F.concat(F.lit("<temporalDomain><timePeriod>"), time("beginPosition", "first"), time("endPosition", "last"), F.lit(f"<timeResolution>{step}</timeResolution></timePeriod></temporalDomain>"))
    values = F.concat(F.lit("<rangeSet><RangeSet>"), label, F.lit(f"<nullValues><singleValue>{missing}</singleValue></nullValues></RangeSet></rangeSet>"))
    return coverages.select("variable", F.concat(F.lit("<CoverageOffering>"), label, F.lit("<domainSet>"), space, period, F.lit("</domainSet>"), values, F.lit("</CoverageOffering>")).alias("line"))


def dump(rows: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """keys, variable, line: each number of the columns as a line of text, in its short form."""
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "variable", "x").select(*keys, "variable", general(F.col("x"), digits).alias("line"))


def provenance(df: DataFrame) -> list[str]:
    """The files that a result comes from."""
    return sorted(df.inputFiles())
