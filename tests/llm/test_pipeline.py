"""Each stage on its own input, against what the operator's brute force says."""

import pytest
from test_decontaminate import distance
from test_jaccard_join import brute

import corpus_pipeline as P
from geoflume.llm import decontaminate as D


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for n, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return [(d.columns, {r.doc_id: r for r in d.collect()}) for d in out]


def test_columns(stages):
    for columns, rows in stages[:-1]:
        assert columns == stages[0][0] and rows
    assert set(stages[-1][0]) == set(stages[0][0]) | {"size", "source_size", "target", "taken"}


def test_toxic_go(spark, sf_dir, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = stages[1][1]
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in left for d in clean) > 0.97 * len(clean)
    assert all(left[d] == stages[0][1][d] for d in left)


def test_lines_go(stages):
    before, after = stages[1][1], stages[2][1]
    held = {}
    for d, r in before.items():
        for x in (r.text or "").split("\n"):
            held.setdefault(x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), set()).add(d)
    assert set(before) == set(after)
    for d, r in before.items():
        kept = [x for x in (r.text or "").split("\n") for k in [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})] if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == d]
        assert after[d].text == "\n".join(kept) and (len(kept) == len((r.text or "").split("\n")) or after[d].n_chars == len(after[d].text))


def test_one_of_each_group(stages):
    before, after = stages[2][1], stages[3][1]
    want = brute([(d, r.text) for d, r in before.items()])
    assert set(after) == {d for d in want if want[d][0] == d}


def test_items_go(spark, sf_dir, stages):
    before, after = stages[3][1], stages[4][1]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(D.normal(D.F.col("text")).alias("text")).collect()]
    assert set(after) <= set(before)
    for d in before:
        words = "".join(c.lower() if c.isalnum() else " " for c in before[d].text or "").split()
        if d in after:
            joined = " ".join(words)
            assert not any(i in joined for i in items)
        else:
            assert any(distance(i.split(), words)[0] <= D.edits(len(i.split())) for i in items)


def test_mix(stages):
    before, after = stages[4][1], stages[5][1]
    assert set(after) <= set(before)
    by = {}
    for r in after.values():
        assert 0 < r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.51


def test_run(spark, sf_dir, stages):
    out = P.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(stages[-1][1])
    from pathlib import Path

    [last] = {str(Path(f.removeprefix("file:")).parent) for f in out.inputFiles()}
    assert sorted(x.name for x in Path(last).parent.iterdir()) == ["4"]


def _words(k, n=40):
    return " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(n))


ODD = [(1, _words(1)), (1, _words(1)), (2, _words(1)), (3, None), (4, ""), (None, _words(5)), (None, _words(6)), (None, None), (7, _words(7)), (7, _words(8)), (9, " \n\t"), (10, _words(9, 60_000))]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_in_every_stage(spark, sf_dir, tmp_path, rows):
    """Nulls in any column, no text, repeated rows, ties of doc_id, a very long text, other columns with clashing names, and an empty table."""
    full = [(i, t, None if k % 3 else "en", "s" if k % 2 else None, len(t) if t else None, k, "x") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, rep int, taken string")
    columns, seen = docs.columns, []
    for n, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append((docs.columns, sorted(str((r.doc_id, r.text)) for r in docs.collect())))
    assert all(c == columns for c, _ in seen[:-1]) and seen[-1][0] == [*columns[:-1], "taken_input", "size", "source_size", "target", "taken"]
    every = sorted(str(r) for r in rows)
    once = sorted(str(r) for k, r in enumerate(rows) if k not in (1, 2))  # one of the three with a text
    for k in (0, 1):
        assert seen[k][1] == every
    for k in (2, 3):
        assert seen[k][1] == once
    worded = {str(r) for k, r in enumerate(rows) if k not in (1, 2) and (r[1] or "").strip()}
    assert set(seen[4][1]) <= worded and bool(seen[4][1]) == bool(rows)  # a sample of what has words
