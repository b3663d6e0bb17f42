"""Text helpers of station tables and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def numeric_id(name: Column, digits: int = 18) -> Column:
    """A number of a site name: letters become 1 to 26, digits stay, the rest goes; the first digits of it."""
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(_LETTERS) for x in (c, str(i + 1))])
    parts = F.transform(F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9]", ""), ""), lambda c: F.coalesce(F.try_element_at(numbers, c), c))
    joined = F.substring(F.array_join(parts, ""), 1, digits)
    return F.when(joined != "", joined).cast("long")


def site_number(name: Column) -> Column:
    """A number of a site name as in numeric_id, of at most 19 digits: of a longer one the first 15 and the last 4."""
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(_LETTERS) for x in (c, str(i + 1))])
    parts = F.transform(F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9]", ""), ""), lambda c: F.coalesce(F.try_element_at(numbers, c), c))
    whole = F.array_join(parts, "")
    short = F.when(F.length(whole) > 19, F.concat(F.left(whole, F.lit(15)), F.right(whole, F.lit(4)))).otherwise(whole)
    return F.when(short != "", short).cast("decimal(19,0)")


def capitalised(name: Column) -> Column:
    """Each word between underscores with a capital."""
    return F.translate(F.initcap(F.translate(name, "_", " ")), " ", "_")


def cleaned(option: Column) -> Column:
    """Characters other than those of names, numbers, lists and times become underscores."""
    return F.regexp_replace(option, r"[^A-Za-z0-9_.,:/+\- ]", "_")


def unquoted(line: Column) -> Column:
    """A line without quotes, and without the commas and brackets between them."""
    return F.array_join(F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, ",[]", "")).otherwise(p)), "")


def word_index(line: Column, word: Column | str, sep: str = ",") -> Column:
    """Position of a word in a line, from 0; -1 if it isn't there."""
    word = word if isinstance(word, Column) else F.lit(word)
    return (F.array_position(F.transform(F.split(line, sep), lambda p: F.trim(p)), word) - 1).cast("int")


def described(*parts: Column) -> Column:
    return F.concat_ws(";", *parts)


def general(number: Column, digits: int = 6) -> Column:
    """A number with so many digits, without zeros at its end; with an exponent below -4 or from ``digits`` on. Decimal halves go up; subnormal numbers (below 2.3e-308) may have fewer figures."""
    x = number.cast("double")
    e = F.format_string(f"%.{digits - 1}e", F.abs(x))
    power = F.substring_index(e, "e", -1).cast("int")
    figures = F.translate(F.substring_index(e, "e", 1), ".", "")
    bare = lambda c: F.regexp_replace(c, r"\.?0*$", "")  # noqa: E731 - of a text with a point
    plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)).otherwise(F.concat(F.left(figures, power + 1), F.lit("."), F.substr(figures, power + 2)))
    short = F.concat(bare(F.concat(F.left(figures, F.lit(1)), F.lit("."), F.substr(figures, F.lit(2)))), F.lit("e"), F.substring_index(e, "e", -1))
    size = F.when(F.abs(x) == float("inf"), "inf").when((power >= -4) & (power < digits), bare(plain)).otherwise(short)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(x.isNotNull(), F.concat(sign, size))
