"""Water-quality events in a stream: linear prediction, then a binomial count of outliers.

Each reading is predicted from the last ``history`` readings of its sensor by a linear
predictor of some order, whose coefficients the Levinson-Durbin recursion makes from
the window's autocorrelation. It is an outlier if it misses the prediction by more
than ``outlier`` standard deviations of the prediction error. Of the last ``window``
readings, the chance that a fair coin gives no more outliers is the event probability;
a reading is part of an event while that is at least ``event``, for ``timeout`` readings:
what lasts longer counts as a new baseline, and the alarm is silent until it ends.

State (one row of at most ``history`` + ``window`` numbers a sensor) is held by
transformWithStateInPandas. An event-time timer frees a sensor's state once the
watermark is ``silence`` past its last reading; a reading after such a gap starts anew
either way, so results don't hang on batches. The same processor runs over a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "sensor long, ts timestamp, value double, prediction double, outlier boolean, probability double, event boolean, baseline boolean, late boolean"


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need; its stream manager, begun by naming it, runs the store's coordinator for batches too."""
    assert spark.streams.active is not None
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def levinson(r: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients a (x[t] is about the sum of a[i] * x[t - 1 - i]) and the error's power from autocorrelations r[0..order]."""
    a, power = np.zeros(0), float(r[0])
    for k in range(1, len(r)):
        if power <= 0:
            return np.concatenate((a, np.zeros(len(r) - k))), 0.0
        reflect = (r[k] - a @ r[k - 1 : 0 : -1]) / power
        a = np.concatenate((a - reflect * a[::-1], [reflect]))
        power *= 1 - reflect * reflect
    return a, max(power, 0.0)


def predict(window: np.ndarray, order: int) -> tuple[float, float]:
    """The next value after a window, and the standard deviation of the prediction's error within it."""
    n, mean = len(window), window.mean()
    x = window - mean
    r = np.array([x[: n - k] @ x[k:] for k in range(order + 1)])
    a, power = levinson(r)
    return float(mean + a @ x[: -order - 1 : -1]), float(np.sqrt(power / n))


def binomial(n: int) -> np.ndarray:
    """Chance of at most 0, 1 .. n heads in n throws."""
    return np.cumsum([comb(n, k) for k in range(n + 1)]) / 2.0**n


class Detector(StatefulProcessor):
    def __init__(self, history: int, order: int, outlier: float, event: float, timeout: int, window: int, silence: pd.Timedelta):
        self.history, self.order, self.outlier, self.event, self.timeout, self.window, self.silence = history, order, outlier, event, timeout, window, silence
        self.warm, self.chance = 2 * order + 2, binomial(window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sensor", "history array<double>, flags array<boolean>, run int, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, flags, run, last = self.state.get() if self.state.exists() else ([], [], 0, None)
        held, flags, last = list(held), list(flags), None if last is None else pd.Timestamp(last)
        before = last
        f = pd.concat(list(rows)).sort_values(["ts", "value"], kind="stable")
        out = []
        for ts, v in zip(f["ts"], f["value"]):
            if last is not None and ts < last:
                out.append((key[0], ts, v, None, False, None, False, False, True))
                continue
            if last is not None and ts - last > self.silence:
                held, flags, run = [], [], 0
            last, guess, far = ts, None, False
            if len(held) >= self.warm:
                guess, spread = predict(np.array(held), self.order)
                far = bool(abs(v - guess) > self.outlier * max(spread, 1e-9))
            held, flags = [*held[-self.history + 1 :], float(v)], [*flags, far][-self.window :]
            p = float(self.chance[sum(flags)]) if len(flags) == self.window else None
            run = run + 1 if p is not None and p >= self.event else 0
            out.append((key[0], ts, v, guess, far, p, 0 < run <= self.timeout, run > self.timeout, False))
        self.state.update((held, flags, run, last.to_pydatetime()))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def _due(self, last: pd.Timestamp) -> int:
        return int((last + self.silence).timestamp() * 1000)

    def close(self) -> None:
        pass


def events(readings: DataFrame, history: int = 432, order: int = 12, outlier: float = 0.9, event: float = 0.85, timeout: int = 15, window: int = 8, silence: str = "2 days", late: str = "1 hour") -> DataFrame:
    """OUT for each reading (sensor, ts, value); readings without a value go, one older than its sensor's last is marked late and changes nothing.

    A stream needs the session of ``stateful``. Rows that are older than the watermark, ``late`` behind the newest, are dropped by Spark.
    """
    rows = readings.filter("sensor is not null and ts is not null and value is not null").select(F.col("sensor").cast("long").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    detector = Detector(history, order, outlier, event, timeout, window, pd.Timedelta(silence))
    return rows.withWatermark("ts", late).groupBy("sensor").transformWithStateInPandas(detector, OUT, "append", "EventTime")
