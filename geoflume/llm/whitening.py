"""Embedding whitening from an exact integer scatter.

Entries become whole numbers, x = floor(scale * c) + shift. Each task subtracts the
shift, cuts the numbers into pieces of 20 bits whose products a float64 matrix
product adds without rounding, and adds those up as Python integers. Its sums and
cross-products leave as limbs of 32 bits in long columns, which Spark adds up, so
they are exact at any size and in any order. The driver, which gets d * (d + 3) / 2 + 1
rows for d dimensions whatever the table's size, forms n * X'X - S S' as integers
and only then goes over to doubles and eigh. Two more scans make the whitened
covariance (the error that is reported) and the result; vectors are never shuffled.

Defined cases: null vectors and vectors with null or non-finite entries are left out;
entries that a vector lacks beside the longest one count as c = 0; |scale * c| is held
at 2**62; a null vec_id stays null; repeated rows each count; components whose
eigenvalue is at most 1e-13 of the largest have a null ``whitened``, and are no part of
identity_error; ``explained`` is null where all vectors are equal; a deviation that
doesn't fit a long is null there and stands in deviation_wide (up to 38 digits);
other columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import table
from geoflume.llm._vectors import doubles, floored, is_valid, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a piece, rows whose products of pieces float64 adds exactly, limbs of a sum and bits of a limb.
_PIECE, _ROWS, _LIMBS, _BITS = 20, 1 << 13, 7, 32
_MOST = 1 << 62
#: An eigenvalue at most this share of the largest counts as 0.
_TINY = 1e-13


@dataclass(frozen=True)
class Scatter:
    """Exact sums of the shifted vectors."""

    n: int
    sums: list[int]
    cross: list[list[int]]

    def numerator(self) -> np.ndarray:
        """n * X'X - S S' as Python integers; the shift cancels in it."""
        s = np.array(self.sums, object)
        return self.n * np.array(self.cross, object) - np.outer(s, s)

    def covariance(self) -> np.ndarray:
        """Each entry rounded once."""
        return np.array([[v / self.n**2 for v in row] for row in self.numerator().tolist()], float).reshape(len(self.sums), len(self.sums))


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray  # a column for each component
    values: np.ndarray
    trace: float
    scale: int

    @property
    def used(self) -> np.ndarray:
        return self.values > _TINY * self.values.max(initial=0.0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S for whole vectors, exact: int64 where that holds it, else Python integers."""
        s = np.array(self.sums, object)
        if int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0) < 1 << 62:
            return y * self.n - s.astype(np.int64)
        return y.astype(object) * self.n - s

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; 0 in components that aren't used."""
        root = np.where(self.used, np.sqrt(np.where(self.used, self.values, 1)), np.inf)
        return (centred.astype(float) / self.n) @ self.axes / root


def rows_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, v of the valid rows."""
    return embeddings.filter(is_valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), doubles(F.col("embedding")).alias("v"))


def _pieces(y: np.ndarray) -> list[np.ndarray]:
    """Signed pieces, lowest first, each a float64 matrix of whole numbers up to 2**19; the high ones only where some number has them."""
    out, half = [], np.int64(1 << (_PIECE - 1))
    while not out or y.any():
        low = ((y + half) & np.int64((1 << _PIECE) - 1)) - half
        out.append(low.astype(float))
        y = (y - low) >> np.int64(_PIECE)
    return out


def exact_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows as arrays of Python integers."""
    d = y.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for k in range(0, len(y), _ROWS):
        parts = _pieces(y[k : k + _ROWS])
        for a, left in enumerate(parts):
            sums = sums + (left.sum(0).astype(np.int64).astype(object) << (_PIECE * a))
            for b, right in enumerate(parts):
                cross = cross + ((left.T @ right).astype(np.int64).astype(object) << (_PIECE * (a + b)))
    return sums, cross


def _grown(a: np.ndarray, d: int) -> np.ndarray:
    """An array of Python integers with d in each direction, the new ones 0."""
    if len(a) == d:
        return a
    out = np.full((d,) * a.ndim, 0, object)
    out[tuple(slice(0, k) for k in a.shape)] = a
    return out


def _limbs(v: int) -> list[int]:
    sign, v = (-1, -v) if v < 0 else (1, v)
    return [sign * ((v >> (_BITS * k)) & ((1 << _BITS) - 1)) for k in range(_LIMBS)]


def scatter(rows: DataFrame, scale: int = SCALE) -> Scatter:
    """Exact sums over rows (v); places i = -1 hold n and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for b in batches:
            y = floored(matrix(b["v"]), scale, _MOST)
            s, c = exact_products(y)
            d = max(len(s), len(sums))
            n, sums, cross = n + len(y), _grown(sums, d) + _grown(s, d), _grown(cross, d) + _grown(c, d)
        if n:
            d = len(sums)
            places = [(-1, -1, n), *((-1, j, int(sums[j])) for j in range(d)), *((i, j, int(cross[i, j])) for i in range(d) for j in range(i, d))]
            limbs = np.array([_limbs(v) for _, _, v in places], np.int64)
            cols = [pa.array([p[k] for p in places], pa.int32()) for k in (0, 1)] + [pa.array(limbs[:, k]) for k in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays(cols, ["i", "j", *(f"l{k}" for k in range(_LIMBS))])

    parts = rows.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS)))
    total = {(r.i, r.j): sum(r[f"l{k}"] << (_BITS * k) for k in range(_LIMBS)) for r in parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]).collect()}
    d = 1 + max((j for _, j in total), default=-1)
    return Scatter(total.get((-1, -1), 0), [total[-1, j] for j in range(d)], [[total[min(i, j), max(i, j)] for j in range(d)] for i in range(d)])


def fit(found: Scatter, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The first components by falling eigenvalue; the largest entry of each is positive."""
    values, axes = np.linalg.eigh(found.covariance()) if found.sums else (np.zeros(0), np.zeros((0, 0)))
    values, axes = np.maximum(values[::-1][:components], 0.0), axes[:, ::-1][:, :components]
    top = np.abs(axes).argmax(0) if axes.size else np.zeros(0, int)
    axes = axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    v = found.numerator()
    trace = sum(v[i, i] for i in range(len(v))) / found.n**2 if found.n else 0.0
    return Whitening(found.n, found.sums, axes, values, trace, scale)


def identity_error(rows: DataFrame, by: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k, d, scale = len(by.values), len(by.sums), by.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = by.project(by.centred(floored(matrix(b["v"], d), scale, _MOST)))
            total += np.vstack((w.T @ w, w.sum(0)))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[k] / by.n
    error = np.abs(total[:k] / by.n - np.outer(mean, mean) - np.eye(k))
    return float(error[np.ix_(by.used, by.used)].max(initial=0.0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide: a row for each valid row and component."""
    rows = rows_of(embeddings)
    by = fit(scatter(rows, scale), components, scale)
    if not len(by.values):
        return embeddings.sparkSession.createDataFrame([], _OUT)
    error, k, d, wide = identity_error(rows, by), len(by.values), len(by.sums), pa.decimal128(38, 0)
    share = by.values / by.trace if by.trace else np.full(k, np.nan)

    def deviations(centred: np.ndarray) -> tuple[pa.Array, pa.Array]:
        top = int(np.abs(centred).max(initial=0))
        if top * top * d < 1 << 63:
            narrow = pa.array((centred.astype(np.int64) ** 2).sum(1))
            return narrow, narrow.cast(pa.decimal128(19, 0)).cast(wide)
        exact = [sum(int(c) ** 2 for c in row) for row in centred]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), pa.array([str(v) if v < 10**38 else None for v in exact]).cast(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                centred = by.centred(floored(matrix(b["v"], d), scale, _MOST))
                w = by.project(centred).ravel()
                n, row = len(centred), np.repeat(np.arange(len(centred)), k)
                narrow, whole = deviations(centred)
                cols = [
                    b["vec_id"].take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, by.n)), narrow.take(pa.array(row)),
                    pa.array(w, mask=np.tile(~by.used, n)), pa.array(np.tile(share, n), mask=np.isnan(np.tile(share, n))), pa.array(np.full(n * k, error)), whole.take(pa.array(row)),
                ]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
#: An eigendecomposition isn't SQL; tests hold every row against a brute-force version.
ORACLE: dict[str, str] = {}
