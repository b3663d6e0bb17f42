from pyspark.sql import functions as F

from geoflume.plans.points import points
from geoflume.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_densify_covers_every_hour(spark):
    hours = points(spark, SF).select(F.date_trunc("hour", "ts")).distinct().count()
    assert hours > 24
    out = QUERIES["densify_grid_all"](spark, SF).groupBy("hour").count().collect()
    assert len(out) <= hours and len(out) > 24 and {r["count"] for r in out} == {1500}


def test_unpivot_covers_every_hour(spark):
    want = points(spark, SF).filter("value is not null").select(F.hour("ts")).distinct().count()
    assert QUERIES["unpivot_all_hours"](spark, SF).select("h").distinct().count() == want > 3
