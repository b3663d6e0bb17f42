"""Time as Columns: packed integers, ISO text, offsets, TAI-93, seasons and ranges.

All functions take and give TIMESTAMP in a UTC session; nulls stay null and text
that isn't a time gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours to add to local time for UTC. Fixed values.
ZONE_HOURS = {
    "AST": 4, "ADT": 3, "EST": 5, "EDT": 4, "CST": 6, "CDT": 5, "MST": 7, "MDT": 6,
    "PST": 8, "PDT": 7, "AKST": 9, "AKDT": 8, "HAST": 10, "HADT": 9, "UTC": 0, "GMT": 0,
}
#: Seconds from 1970 to 1993 and the leap seconds between TAI-93 and UTC as the product files count them.
TAI93_OFFSET = 725846394


def pack(ts: Column, pattern: str = "yyyyMMddHH") -> Column:
    """A time as an integer of its digits."""
    return F.date_format(ts, pattern).cast("long")


def unpack(stamp: Column, pattern: str = "yyyyMMddHH", first: int = 1900, last: int = 9999) -> Column:
    """The time of a packed integer; null unless it is one in the years given."""
    ts = F.try_to_timestamp(F.lpad(stamp.cast("string"), len(pattern), "0"), F.lit(pattern))
    return F.when(F.year(ts).between(first, last) & (F.length(stamp.cast("string")) <= len(pattern)), ts)


def iso(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS-0000."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-0000'")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def from_text(text: Column) -> Column:
    """m/d/yyyy hh:mm[,utc offset] or YYYY-MM-DD[ T]hh…, to the hour; an offset is what local time is ahead of UTC."""
    us = F.try_to_timestamp(F.regexp_extract(text, r"^(\d+/\d+/\d{4} \d+):\d+", 1), F.lit("M/d/yyyy H"))
    off = F.regexp_extract(text, r",\s*([+-]?\d+)\s*$", 1)
    us = to_utc(us, F.when(off == "", 0).otherwise(off.try_cast("int")))
    sql = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[ T]\d\d)", 1), "T", " "), F.lit("yyyy-MM-dd HH"))
    return F.coalesce(us, sql)


def to_utc(ts: Column, ahead: Column) -> Column:
    """UTC of local time that is so many hours ahead of it: a negative offset adds, a positive one subtracts."""
    return F.timestamp_add("HOUR", -ahead, ts)


def zone_to_utc(ts: Column, zone: Column) -> Column:
    """UTC of local time in a named zone; an unknown zone counts as UTC."""
    hours = F.create_map(*[F.lit(x) for kv in ZONE_HOURS.items() for x in kv])
    return F.timestamp_add("HOUR", F.coalesce(F.try_element_at(hours, F.upper(F.trim(zone))), F.lit(0)), ts)


def tai93(seconds: Column) -> Column:
    return F.timestamp_seconds((F.floor(seconds + 0.5) + TAI93_OFFSET).cast("long"))


def hours_in(start: Column, end: Column) -> Column:
    """Hours from start to end, both ends counted."""
    return F.timestamp_diff("HOUR", F.date_trunc("hour", start), F.date_trunc("hour", end)) + 1


def days_in(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def season(ts: Column) -> Column:
    """Year and season of a month, as 2024DJF; December counts to the next year."""
    ahead = F.add_months(F.to_date(ts), 1)
    return F.concat(F.year(ahead).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("DJF", "MAM", "JJA", "SON")]), F.quarter(ahead)))


def end_of(ts: Column, unit: str) -> Column:
    """The last second of the day, month or year."""
    step = {"day": "DAY", "month": "MONTH", "year": "YEAR"}[unit]
    return F.timestamp_add("SECOND", F.lit(-1), F.timestamp_add(step, F.lit(1), F.date_trunc(unit, ts)))


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def of_file_name(path: Column) -> Column:
    """The time that a file name ends in: _YYYY, _YYYYMM, _YYYYDDD or _YYYYMMDD."""
    digits = F.regexp_extract(path, r"_(\d{4}|\d{6}|\d{7}|\d{8})\.[^./]*$", 1)
    shapes = {4: "yyyy", 6: "yyyyMM", 7: "yyyyDDD", 8: "yyyyMMdd"}
    return F.coalesce(*[F.when(F.length(digits) == n, F.try_to_timestamp(digits, F.lit(p))) for n, p in shapes.items()])


def calendar(start: Column, end: Column, step: str = "1 HOUR") -> Column:
    """The times from start to end, both counted."""
    return F.sequence(start, end, F.expr(f"INTERVAL {step}"))


def is_stamp(stamp: Column, pattern: str = "yyyyMMddHH", first: int = 1900, last: int = 9999) -> Column:
    """Whether a packed integer is a time in the years given."""
    return unpack(stamp, pattern, first, last).isNotNull()


def month_day(yyyyddd: Column) -> tuple[Column, Column]:
    ts = unpack(yyyyddd, "yyyyDDD")
    return F.month(ts), F.dayofmonth(ts)


def stepped(stamp: Column, amount: Column | int, unit: str = "HOUR", pattern: str = "yyyyMMddHH") -> Column:
    """A packed time so many units later, or earlier for a negative amount."""
    return pack(F.timestamp_add(unit, amount if isinstance(amount, Column) else F.lit(amount), unpack(stamp, pattern)), pattern)


def dods_hour(seconds: Column) -> Column:
    """yyyymmddhh of seconds since 1970, cut to the hour."""
    return pack(F.timestamp_seconds(F.floor(seconds)))


def fractional_hour(ts: Column) -> Column:
    """Hour of the day with minutes and seconds as its fraction."""
    return F.hour(ts) + F.minute(ts) / 60 + F.floor(F.second(ts)) / 3600


def counted(ts: Column, start: Column) -> Column:
    """Hours since a start, from 0; fractions kept."""
    return (F.unix_micros(ts) - F.unix_micros(start)) / 3.6e9


def labels(first: Column, steps: int, hours: int) -> Column:
    """yyyymmddhh of so many steps: of 8760 hours the 1st of January of each year, of 744 the first of each month, else so many hours on."""
    unit, start = ("YEAR", F.date_trunc("year", first)) if hours == 8760 else ("MONTH", F.date_trunc("month", first)) if hours == 744 else ("HOUR", first)
    n = 1 if unit != "HOUR" else hours
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: pack(F.timestamp_add(unit, i * n, start)))
