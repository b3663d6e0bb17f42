import hashlib
import random
import re

import pytest

from geoflume.llm import substring_dedup as S


def brute(rows, k=20):
    docs = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    first, out = {}, []
    for d, w in sorted(docs, key=lambda x: x[0]):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (d, i))
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] != (d, i):
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, hashlib.sha256(kept).hexdigest(), len(gone), len(w)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.kept_sha256, r.n_removed, r.n_words) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert got(S.op1_substring_dedup(spark, sf_dir)) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("hot", [1, 3, 2000])
def test_few_words(make_docs, hot):
    """A vocabulary of three words makes windows repeat within and across documents, whichever way they travel."""
    rng = random.Random(hot)
    rows = [(i, " ".join(rng.choice("aab") * rng.randint(1, 2) for _ in range(rng.randint(0, 90)))) for i in range(30)]
    rows += [(100, "x " * 70), (101, "y\t\n" + "x " * 25), (102, " ".join(map(str, range(200))) + " " + " ".join(map(str, range(150))))]
    assert got(S.substring_dedup(make_docs(*rows), k=6, m=2, hot=hot)) == brute(rows, 6)


def test_edges(make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    df = make_docs((None, text), (1, None), (2, ""), (3, text + " é "), (3, text), (5, text), (5, text))
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in S.substring_dedup(df.withColumn("n_words", df.n_chars).withColumn("id", df.lang)).collect()), key=repr)
    assert (None, 25, 0) in out and (1, 0, 0) in out and (2, 0, 0) in out
    assert out.count((5, 25, 25)) == 2 and (3, 25, 25) in out and (3, 25, 24) in out
    assert S.substring_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 2000])
def test_a_repeated_row_does_not_repeat_itself(make_docs, hot):
    """Two to sixty rows of one doc_id and text, in one task and in many, with and without an earlier document."""
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    rows = [(5, text)] * 60 + [(None, other)] * 7 + [(9, other), (8, "x"), (7, text), (3, "y " * 19 + other)]
    for df in (make_docs(*rows).coalesce(1), make_docs(*rows).repartition(13)):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in S.substring_dedup(df, hot=hot).collect())
        assert got == sorted([("5", 30, 0)] * 60 + [("None", 30, 0)] * 7 + [("9", 30, 30), ("8", 1, 0), ("7", 30, 30), ("3", 49, 30)])
    assert got_one(make_docs((5, text), (5, text))) == [(5, 30, 0)] * 2


def got_one(df):
    return [(r.doc_id, r.n_words, r.n_removed) for r in S.substring_dedup(df).collect()]


def test_a_frequent_minimiser_is_split(spark, make_docs):
    """The places of a passage that 3000 documents share don't stay in one task of the join."""
    passage = " ".join(f"p{i}" for i in range(22))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(3000)]
    small = {"advisoryPartitionSizeInBytes": "1k", "skewJoin.skewedPartitionThresholdInBytes": "2k", "skewJoin.skewedPartitionFactor": "1", "coalescePartitions.enabled": "false"}
    try:
        for name, value in small.items():
            spark.conf.set(f"spark.sql.adaptive.{name}", value)
        found = S.repeating(S.keyed(make_docs(*rows).repartition(8)))
        assert found.count() == 3000
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "AQEShuffleRead skewed" in plan, plan
        assert got(S.substring_dedup(make_docs(*rows).repartition(8))) == brute(rows)
    finally:
        for name in small:
            spark.conf.unset(f"spark.sql.adaptive.{name}")


def test_very_long_text(make_docs):
    """A megabyte of one word repeated, and of different words with a passage of another document in them."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage), (2, " ".join(f"w{i}" for i in range(60000)) + " " + passage + " tail" * 10), (3, "z " * 200000)]
    assert got(S.substring_dedup(make_docs(*rows))) == brute(rows)
