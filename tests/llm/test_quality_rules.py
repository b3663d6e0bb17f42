import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest

from geoflume.llm import quality_rules as Q
from conftest import DOC, sorted_rows

SPACE = " \t\n\x0b\x0c\r"


def plain_counts(text):
    words = [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_whole_table_against_sql(spark, sf_dir, duck):
    df = Q.op11_quality_rules(spark, sf_dir)
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert sorted_rows(df) == duck(Q.ORACLE["op11_quality_rules"], documents=docs)


def test_counts_against_plain_python(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")
    for r in Q.op11_quality_rules(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(docs.text[r.doc_id]), r.doc_id


def test_estimates_against_numpy(spark):
    """Each group's model is that of concentration steps written out over the rows themselves."""
    rng = np.random.default_rng(3)
    rows = []
    for g, (n, shift) in enumerate([(300, 0), (180, 20)]):
        good = rng.multivariate_normal([shift, 30, 5, 160, 25], np.diag([4, 30, 9, 16, 9]) + 2.0, n)
        bad = rng.normal([90, 80, 60, 250, 90], 3, (n // 6, 5))
        rows += [("en", f"s{g}", *map(int, np.rint(x))) for x in np.vstack((good, bad))]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} long" for i in range(5)))
    got = {(r.source, r.pooled): r for r in Q.estimates(Q.vectors(df)).collect()}
    floor = np.diag([s**2 for _, s in Q.STATISTICS])
    for key in (("s0", False), ("s1", False), (None, True)):
        x = np.array([r[2:] for r in rows if key[1] or r[1] == key[0]], float)
        m = np.median(x, 0)
        v = np.diag((1.4826 * np.median(np.abs(x - m), 0)) ** 2) + floor
        for _ in range(Q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
            level = np.floor(16 * np.log(d + 1e-6))
            part = x[level <= np.sort(level)[int(np.ceil(Q.HALF * len(x))) - 1]]
            m, v = part.mean(0), np.cov(part.T, bias=True) * Q.FACTOR + floor
        r = got[key]
        low = np.eye(5)
        for i in range(5):
            for j in range(i):
                low[i, j] = r[f"l{i}_{j}"]
        assert r["size"] == len(x)
        assert np.allclose([r[f"m{i}"] for i in range(5)], m)
        assert np.allclose(low @ np.diag([r[f"d{i}"] for i in range(5)]) @ low.T, v)


def test_junk_goes_and_clean_stays(spark, sf_dir):
    """Labelled quality of the table: not one clean document that passes the fixed limits goes, and over nine tenths of the bad ones do."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.base_failed, r.kept) for r in Q.op11_quality_rules(spark, sf_dir).collect() if r.doc_id in labels]
    assert all(kept or failed for q, failed, kept in rows if q == 1)
    bad = [kept for q, _, kept in rows if q == 0]
    assert len(bad) > 5 and sum(bad) <= 0.1 * len(bad)


def test_chi_square():
    assert Q.chi2_cdf(Q.chi2_quantile(0.75, 5), 5) == pytest.approx(0.75)
    assert Q.chi2_quantile(0.95, 2) == pytest.approx(5.991464547)
    assert Q.chi2_cdf(7.0, 7) == pytest.approx(0.5711201424)


WORDS = [hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 6] for i in range(500)]


def prose(seed, n=80):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_edges(spark, make_docs):
    good = [(i, prose(i)) for i in range(70)]
    odd = [(None, prose(900)), (None, prose(901)), (500, None), (501, ""), (502, " \t\r\n "), (503, "one two"), (504, "a b c d e f g h " * 9), (5, prose(5)), (5, prose(5)), (505, "!!!" + "$ " * 90 + prose(7))]
    df = Q.judged(make_docs(*good, *odd))
    rows = df.collect()
    assert len(rows) == 80
    of = {r.doc_id: r for r in rows}
    for i in (500, 501, 502):
        assert (of[i].n_words, of[i].word_chars, of[i].base_failed, of[i].kept) == (0, 0, True, False)
    assert of[504].n_repeat_words == 72 and of[504].base_failed
    assert not of[505].kept
    assert all(of[i].kept for i in range(70)), [i for i in range(70) if not of[i].kept]
    assert sum(r.doc_id is None and r.kept for r in rows) == 2
    assert sum(r.doc_id == 5 and r.kept for r in rows) == 3


def test_null_groups_clashing_columns_and_empty_table(spark):
    rows = [(i, prose(i), None if i % 2 else "en", None if i % 3 else "s", 1, "x") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, pooled int, level string")
    got = Q.judged(df).collect()
    assert len(got) == 130 and all(r.kept for r in got)
    assert Q.judged(spark.createDataFrame([], DOC)).collect() == []


def test_all_alike(spark, make_docs):
    got = Q.judged(make_docs(*[(i, prose(1)) for i in range(60)])).collect()
    assert all(r.kept for r in got)


def test_very_long_texts_in_linear_time(spark, make_docs):
    once, twice = prose(1, 300_000), prose(2, 100_000)
    lines = "\n".join(f"line {i % 50_000} of many" for i in range(100_000))
    began = time.time()
    got = {r.doc_id: r for r in Q.judged(make_docs((1, once), (2, f"{twice} {twice}"), (3, lines))).collect()}
    assert time.time() - began < 60
    assert got[1].n_repeat_words == 0 and got[1].n_words == 300_000
    assert got[2].n_repeat_words == 200_000 and got[2].base_failed
    assert got[3].n_dup_lines == 50_000


@pytest.mark.parametrize("seed", range(4))
def test_repeated_words_on_random_texts(spark, make_docs, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices("abc"[: r.randint(1, 3)], k=r.randint(0, 40))) for _ in range(25)]
    got = {x.doc_id: x for x in Q.counts(make_docs(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == plain_counts(t)[4], t
