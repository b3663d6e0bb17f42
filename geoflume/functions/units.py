"""Units and depth rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: unit, target, factor, offset: target = value * factor + offset. Fixed values.
UNITS = (
    ("deg c", "C", 1.0, 0.0),
    ("deg f", "C", 5.0 / 9.0, -160.0 / 9.0),
    ("f", "C", 5.0 / 9.0, -160.0 / 9.0),
    ("k", "C", 1.0, -273.15),
    ("ft", "m", 0.3048, 0.0),
    ("feet", "m", 0.3048, 0.0),
    ("in", "m", 0.0254, 0.0),
    ("cm", "m", 0.01, 0.0),
    ("mm", "m", 0.001, 0.0),
    ("mph", "m/s", 0.44704, 0.0),
    ("kt", "m/s", 1852.0 / 3600.0, 0.0),
    ("cfs", "m3/s", 0.028316846592, 0.0),
    ("pa", "hPa", 0.01, 0.0),
    ("mbar", "hPa", 1.0, 0.0),
    ("ug/l", "mg/l", 0.001, 0.0),
    ("mol/m2", "molecules/cm2", 6.022141e19, 0.0),
)


def converted(value: Column, unit: Column) -> tuple[Column, Column]:
    """A value and its unit in the unit's target; an unknown unit stays. The table is a map expression, so nothing is joined."""
    known = F.create_map(*[F.lit(x) if i == 0 else F.struct(*[F.lit(y) for y in x]) for u, *rest in UNITS for i, x in enumerate((u, rest))])
    rule = F.try_element_at(known, F.lower(F.trim(unit)))
    return F.coalesce(value * rule["col2"] + rule["col3"], value), F.coalesce(rule["col1"], unit)


def convert(df: DataFrame, unit: str = "unit", value: str = "value", depth: bool = False) -> DataFrame:
    """value and unit in their target units, as converted() gives them. depth makes metres negative."""
    v, target = converted(F.col(value), F.col(unit))
    if depth:
        v = F.when(target == "m", -F.abs(v)).otherwise(v)
    return df.select(*[v.alias(c) if c == value else target.alias(c) if c == unit else F.col(f"`{c}`") for c in df.columns])


def depth_of(kind: Column, depth: Column) -> Column:
    """-0.1 at the surface, half the depth at mid-water, else the depth; below the surface is negative."""
    return F.when(F.lower(kind).contains("surface"), -0.1).when(F.lower(kind).contains("mid"), -depth / 2).otherwise(-depth)


def below(depth: Column) -> Column:
    return F.when(depth > 0, -depth).otherwise(depth)


def try_sum(a: Column, b: Column) -> Column:
    """Sum in which NaN counts as missing."""
    return F.when(~F.isnan(a) & ~F.isnan(b), a + b)


def try_difference(a: Column, b: Column) -> Column:
    return F.when(~F.isnan(a) & ~F.isnan(b), a - b)


def try_product(a: Column, b: Column) -> Column:
    return F.when(~F.isnan(a) & ~F.isnan(b), a * b)


def try_quotient(a: Column, b: Column) -> Column:
    """Quotient; null for NaN and for a divisor of 0."""
    return F.when(~F.isnan(a) & ~F.isnan(b), F.try_divide(a, b))


def about_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within a tolerance, relative for values over 1."""
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
