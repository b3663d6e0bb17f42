import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoflume.llm import hard_negatives as H
from conftest import sorted_rows

EMB = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, k=5, m=10):
    """rows: distinct (id, label, list of whole numbers)."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        score = {(i, lab): sum(x * y for x, y in zip(v, w)) for i, lab, w in rows if i != a}
        for p, ps in sorted(((i, s) for (i, lab), s in score.items() if lab == label), key=lambda x: (-x[1], x[0]))[:k]:
            fit = sorted(((-s, i) for (i, lab), s in score.items() if lab != label and 30 * ps <= 100 * s <= 90 * ps))[:m]
            out += [(a, p, r, i, ps, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows, folder, schema=EMB):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def altered(rows):
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows]


def test_whole_table_against_sql(spark, sf_dir, duck):
    emb = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    assert sorted_rows(H.op12_hard_negatives(spark, sf_dir)) == duck(H.ORACLE["op12_hard_negatives"], embeddings=emb)


@pytest.mark.parametrize("clusters", [0, 6])
def test_small_groups_blocks_and_many_pivots(spark, clusters, monkeypatch):
    """Many cells, groups and blocks; rows with ties (few whole numbers) and copies; clustered or not."""
    rng = np.random.default_rng(clusters)
    centres = rng.integers(-30, 30, (max(clusters, 1), 4))
    v = centres[rng.integers(0, len(centres), 400)] + rng.integers(-3, 4, (400, 4))
    v[50:120] = v[50]
    rows = [(int(i), int(rng.integers(0, 3)), x.astype(float).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>").repartition(5)
    pivots = H.cells
    monkeypatch.setattr(H, "cells", lambda rows, anchors, scale: pivots(rows, 128 * 9, scale))
    real = H.best
    monkeypatch.setattr(H, "best", lambda *a: real(*a, per_group=5, per_block=60))
    assert rows_of(H.mine(df, 10, scale=1)) == brute(rows, 10)


def test_rings_leave_far_cells_out(spark):
    """Two far clusters: positives of one are never sought in the other's rows."""
    rng = np.random.default_rng(1)
    v = np.vstack((rng.integers(80, 100, (300, 2)), rng.integers(-100, -80, (300, 2))))
    df = spark.createDataFrame([(i, 0, x.astype(float).tolist()) for i, x in enumerate(v)], "id long, label long, v array<double>")
    by = H.Cells(np.hstack((np.array([[90.0, 90.0], [-90.0, -90.0]]), [[60.0], [60.0]])), int((v**2).sum(1).max()), 600, 2)
    anchors = H.anchors_of(df, by, 10, 1).withColumns({"p_id": F.lit(None).cast("long"), "p_score": F.lit(None).cast("long"), "low": F.lit(H._NONE), "high": F.lit(H._ALL)})
    seen = []
    real = H._chunks

    def chunks(*a):
        out = real(*a)
        seen.append(sum(len(r.ids) // 8 for r in out.collect()))
        return out

    H._chunks = chunks
    try:
        got = H.best(anchors, df, by, 3, True, 1)
        assert got.count() == 180
    finally:
        H._chunks = real
    assert seen[0] == 600 and seen[1] < 60, seen


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [0.25], 2), (4, [0.5], 2), (5, [0.5, None], 2), (6, [nan, 1.0], 2), (8, [inf, 1.0], 2),
        (9, None, 2), (10, [0.5, 0.1], None), (None, [0.5, 0.1], 2), (11, [], 3), (12, [0.3, 0.3], 3), (12, [0.3, 0.3], 3), (200, [-1.0, -1.0], 4), (201, [0.5, 0.0], 4), (300, [0.1, 0.1], 9), (7, [0.4, 0.2], 0),
    ]
    distinct = [r for k, r in enumerate(rows) if r not in rows[:k] and None not in (r[0], r[1], r[2]) and None not in r[1] and all(np.isfinite(r[1]))]
    wide = [(i, v, lab, "x", 5) for i, v, lab in rows]
    got = rows_of(H.op12_hard_negatives(spark, table(spark, wide, tmp_path, EMB + ", id string, cell int")))
    want = brute(altered([(i, [*v, 0.0, 0.0][:2], lab) for i, v, lab in distinct]))
    assert got == want and got


def test_empty_table(spark, tmp_path):
    assert rows_of(H.op12_hard_negatives(spark, table(spark, [], tmp_path))) == []


def test_no_anchor_and_one_row(spark, tmp_path):
    assert rows_of(H.op12_hard_negatives(spark, table(spark, [(1, [0.5], 1), (2, [0.5], 2)], tmp_path / "a"))) == []
    assert rows_of(H.op12_hard_negatives(spark, table(spark, [(100, [0.5], 1)], tmp_path / "b"))) == []


def test_large_numbers_are_exact(spark, tmp_path):
    rows = [(0, [1e5, 1e5 + 1], 1), (1, [1e5, 1e5 - 1], 1), (2, [9e4, 8.5e4], 2), (3, [9e4, 8.5e4 + 0.25], 2), (4, [1e30, 1.0], 3)]
    got = rows_of(H.op12_hard_negatives(spark, table(spark, rows, tmp_path)))
    assert got == brute(altered(rows[:4]))


def test_local_scores_beyond_float64():
    a = np.array([[1 << 27, 3], [5, -7]])
    b = np.array([[(1 << 27) - 1, 1], [1, 2]])
    assert H.scores(a, b).tolist() == [[int(x) * int(p) + int(y) * int(q) for p, q in b] for x, y in a]
