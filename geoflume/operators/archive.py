"""One relation over an archive and the live rows that it will take in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boundary(today: dt.date, days: int = 90) -> dt.date:
    """The first day that is served from live rows."""
    return today - dt.timedelta(days=days)


def switched(archive: DataFrame, live: DataFrame, keys: list[str], ts: str, today: dt.date, days: int = 90, grace: int = 30) -> DataFrame:
    """Rows older than ``days`` from the archive, younger ones from the live rows, with ``origin``; each key once.

    The archive may lag: a live row of up to ``grace`` days beyond the boundary
    stands in while the archive lacks its key, and gives way once it is there; so
    no row is lost or twice when the boundary passes it. Both sides may hold any
    rows; each is pruned by ``ts`` before anything is joined, and only the days of
    grace are (keys of the archive against keys of the live rows).
    """
    edge, first = F.lit(boundary(today, days)).cast("timestamp"), F.lit(boundary(today, days + grace)).cast("timestamp")
    old = archive.filter(F.col(ts) < edge)
    waiting = live.filter((F.col(ts) >= first) & (F.col(ts) < edge)).join(archive.filter((F.col(ts) >= first) & (F.col(ts) < edge)).select(*keys), keys, "left_anti")
    new = live.filter(F.col(ts) >= edge).unionByName(waiting)
    return old.withColumn("origin", F.lit("archive")).unionByName(new.select(*old.columns).withColumn("origin", F.lit("live")))
