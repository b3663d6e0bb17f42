import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from geoflume.streaming import detect as D

SCHEMA = "sensor long, ts timestamp, value double"


def brute(rows, history, order, outlier, event, timeout, window, silence):
    """Every reading by itself: normal equations solved whole, the binomial sum written out."""
    out = []
    for s in sorted({r[0] for r in rows}):
        own = sorted((ts, v) for k, ts, v in rows if k == s)
        start, marks, run = 0, [], 0
        for i, (ts, v) in enumerate(own):
            if i and ts - own[i - 1][0] > silence:
                start, marks, run = i, [], 0
            past = np.array([x for _, x in own[max(start, i - history) : i]])
            guess, far = None, False
            if len(past) >= 2 * order + 2:
                m, n = past.mean(), len(past)
                c = past - m
                r = np.array([sum(c[t] * c[t + k] for t in range(n - k)) for k in range(order + 1)])
                a, power = np.zeros(order), 0.0
                if r[0] > 0:
                    a = np.linalg.solve(np.array([[r[abs(x - y)] for y in range(order)] for x in range(order)]), r[1:])
                    power = r[0] - a @ r[1:]
                guess = m + sum(a[k] * c[-1 - k] for k in range(order))
                far = abs(v - guess) > outlier * max(math.sqrt(max(power, 0) / n), 1e-9)
            marks.append(far)
            last = marks[-window:]
            p = sum(math.comb(window, k) for k in range(sum(last) + 1)) / 2**window if len(last) == window else None
            run = run + 1 if p is not None and p >= event else 0
            out.append((s, ts, v, guess, far, p, 0 < run <= timeout, run > timeout))
    return out


def readings(seed=4):
    rng, rows = np.random.default_rng(seed), []
    for s in (1, 2, 3):
        at = dt.datetime(2024, 1, 1)
        for i in range(260):
            at += dt.timedelta(minutes=5) if i not in (90, 91) else dt.timedelta(days=3)
            burst = 30.0 * (-1) ** i if s == 2 and 150 <= i < 185 else 0.0
            rows.append((s, at, float(np.sin(i / 9 * s) * 5 + rng.normal(0, 0.2) + burst)))
    rows += [(4, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 7.0) for i in range(40)]
    return rows


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[1], g[2], g[4], g[6], g[7]) == (w[0], w[1], w[2], w[4], w[6], w[7]), (g, w)
        assert g[5] == w[5] and (g[3] is None) == (w[3] is None) and (g[3] is None or math.isclose(g[3], w[3], rel_tol=1e-6, abs_tol=1e-6))


SET = {"history": 60, "order": 5, "outlier": 0.9, "event": 0.85, "timeout": 3, "window": 8}


def rows_of(df):
    return sorted(((r.sensor, r.ts, r.value, r.prediction, r.outlier, r.probability, r.event, r.baseline) for r in df.collect()), key=lambda r: r[:3])


def test_batch_against_brute_force(spark):
    D.stateful(spark)
    rows = readings()
    got = rows_of(D.events(spark.createDataFrame(rows, SCHEMA), **SET, silence="2 days"))
    same(got, brute(rows, **SET, silence=dt.timedelta(days=2)))
    assert any(r[6] for r in got if r[0] == 2) and any(r[7] for r in got if r[0] == 2) and not any(r[4] for r in got if r[0] == 4)


def test_stream_in_pieces_equals_brute_force_and_frees_state(spark, tmp_path):
    D.stateful(spark)
    rows = sorted(readings(), key=lambda r: r[1])
    src = tmp_path / "in"
    src.mkdir()
    for k in range(0, len(rows), 120):
        part = pd.DataFrame(rows[k : k + 120], columns=["sensor", "ts", "value"])
        part["ts"] = part["ts"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
        part.to_parquet(src / f"{k:05}.parquet")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = D.events(stream, **SET, silence="2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    same(got, brute(rows, **SET, silence=dt.timedelta(days=2)))
    held = {r.key.sensor for r in spark.read.format("statestore").option("stateVarName", "sensor").load(f"{tmp_path}/state").collect()}
    assert held == {1, 2, 3}  # sensor 4 fell silent six days before the others' last reading


def test_late_rows_and_nulls(spark):
    D.stateful(spark)
    at = dt.datetime(2024, 1, 1)
    det = D.Detector(8, 1, 0.9, 0.85, 3, 4, pd.Timedelta("1 day"))

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Timers:
        due = set()

        def registerTimer(self, t):
            self.due.add(t)

        def deleteTimer(self, t):
            self.due.remove(t)

    det.state, det.handle = Value(), Timers()
    f = lambda *m: iter([pd.DataFrame({"ts": [pd.Timestamp(at) + pd.Timedelta(minutes=x) for x in m], "value": [float(x) for x in m]})])
    [first] = det.handleInputRows((1,), f(0, 10, 20), None)
    [second] = det.handleInputRows((1,), f(5, 30), None)
    assert list(first.late) == [False] * 3 and list(second.late) == [True, False] and det.state.held[0] == [0.0, 10.0, 20.0, 30.0]
    assert len(det.handle.due) == 1
    rows = [(None, at, 1.0), (1, None, 1.0), (1, at, None), (1, at, 1.0), (1, at, 1.0)]
    assert D.events(spark.createDataFrame(rows, SCHEMA)).count() == 2
    assert D.events(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_levinson_solves_the_normal_equations(seed):
    x = np.random.default_rng(seed).normal(size=50)
    r = np.array([x[: 50 - k] @ x[k:] for k in range(9)])
    a, power = D.levinson(r)
    want = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(8)] for i in range(8)]), r[1:])
    assert np.allclose(a, want) and power == pytest.approx(r[0] - want @ r[1:])
