import datetime as dt

from geoflume.operators.archive import boundary, switched


def test_no_row_twice_or_lost_when_the_boundary_passes(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    every = [(i, day(i % 200), float(i)) for i in range(600)]
    make = lambda rows: spark.createDataFrame(rows, "id long, ts timestamp, value double")
    live = make([r for r in every if r[1] >= day(30)])
    for today in range(150, 215, 7):
        date = (dt.datetime(2024, 1, 1) + dt.timedelta(days=today)).date()
        lag = today - 105  # the archive has all up to there, and some of what follows
        archive = make([r for r in every if r[1] < day(lag) or r[1] < day(lag + 10) and r[0] % 3 == 0])
        got = switched(archive, live, ["id"], "ts", date, 90, 30).collect()
        assert sorted(r.id for r in got) == list(range(600))
        assert all(r.origin == "live" for r in got if r.ts.date() >= boundary(date, 90))
        assert all(r.origin == "archive" for r in got if r.ts < day(lag))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, ts timestamp")
    one = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, ts timestamp")
    today = dt.date(2024, 4, 20)
    assert [r.origin for r in switched(none, one, ["id"], "ts", today).collect()] == ["live"]
    assert [r.origin for r in switched(one, none, ["id"], "ts", today).collect()] == ["archive"]
