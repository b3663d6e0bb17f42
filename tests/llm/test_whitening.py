import numpy as np
import pandas as pd
import pytest
from fractions import Fraction

from geoflume.llm import whitening as W

EMB = "vec_id long, embedding array<double>, label int"


def plain(vectors, k=32):
    """Whitened (absolute), deviations and explained shares of whole vectors, from exact fractions."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    return np.abs(z @ u / np.sqrt(e)), [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], e / np.trace(v)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whole_table_against_exact_fractions(spark, sf_dir):
    emb = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    got = by_id(W.op13_whitening(spark, sf_dir))
    white, deviations, explained = plain(emb.embedding.tolist())
    assert len(got) == len(emb) and all(sorted(c) == list(range(1, 33)) for c in got.values())
    for i, w, dev in zip(emb.vec_id, white, deviations):
        rows = [got[i][c] for c in range(1, 33)]
        assert {r.n for r in rows} == {len(emb)} and {r.deviation for r in rows} == {dev}
        assert np.allclose(np.abs([r.whitened for r in rows]), w, atol=1e-9)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9)
    assert len({r.identity_error for c in got.values() for r in c.values()}) == 1
    assert got[0][1].identity_error < 1e-9


def test_covariance_of_the_result_is_the_identity(spark, sf_dir):
    got = by_id(W.op13_whitening(spark, sf_dir))
    w = np.array([[c[k].whitened for k in range(1, 33)] for c in got.values()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() == pytest.approx(got[0][1].identity_error, abs=1e-12)


def test_sums_are_exact_however_dealt(spark):
    """Numbers far beyond 2**53, over one and many partitions."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-(2**50), 2**50, 3)], 0) for i in range(40)]
    want = np.array([[int(c) * 64 for c in v] for _, v, _ in rows], object)
    for parts in (1, 7):
        df = W.rows_of(spark.createDataFrame(rows, EMB).repartition(parts))
        found = W.scatter(df)
        assert found.n == 40 and found.sums == list(want.sum(0)) and found.cross == (want.T @ want).tolist()


def test_products_of_pieces():
    rng = np.random.default_rng(2)
    y = rng.integers(-(2**62), 2**62, (50, 4))
    sums, cross = W.exact_products(y)
    o = y.astype(object)
    assert sums.tolist() == o.sum(0).tolist() and cross.tolist() == (o.T @ o).tolist()
    assert W._limbs(-5)[0] == -5 and sum(x << (32 * k) for k, x in enumerate(W._limbs(-(3**130)))) == -(3**130)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0], 1), (1, [0.5, 1.0], 1), (2, [-0.25], None), (None, [1.0, 2.0], 1), (3, [], 1), (4, None, 1), (5, [None, 1.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [0.1, -inf], 1),
    ]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], EMB + ", component int, n int")
    got = W.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted([(False, i, c) for i in (1, 1, 2, 3) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)])
    assert {r.n for r in got} == {5}
    white, deviations, _ = plain([[0.5, 1.0], [0.5, 1.0], [-0.25, 0.0], [1.0, 2.0], [0.0, 0.0]], 2)
    of = {(r.vec_id, r.component): r for r in got}
    for i, row in ((1, 0), (2, 2), (None, 3), (3, 4)):
        assert np.allclose([abs(of[i, c].whitened) for c in (1, 2)], white[row]) and of[i, 1].deviation == deviations[row]


def test_empty_table_one_row_and_equal_rows(spark):
    assert W.whiten(spark.createDataFrame([], EMB)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None, 1)], EMB)).collect() == []
    got = W.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(4)], EMB)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(None, None, 0.0, 0)} and len(got) == 8


def test_a_flat_direction_has_no_whitened_value(spark):
    got = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(9)], EMB)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True)} and got[0].identity_error < 1e-12


def test_deviation_beyond_a_long(spark):
    rows = [(i, [2.0**40 * i, 1.0], 1) for i in range(4)]
    got = by_id(W.whiten(spark.createDataFrame(rows, EMB)))
    _, want, _ = plain([v for _, v, _ in rows], 2)
    for i in range(4):
        assert int(got[i][1].deviation_wide) == want[i] and got[i][1].deviation == (want[i] if want[i] < 2**63 else None)
