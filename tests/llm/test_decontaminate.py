import random

import pyarrow as pa
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from geoflume.llm import decontaminate as D


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70)


@settings(max_examples=150, deadline=None)
@given(words.filter(bool), words)
def test_myers(pattern, text):
    assert D.myers(pattern, text) == distance(pattern, text)


def test_against_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(12)]
    docs = []
    for i in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, len(passage) // 4 + 1)):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
                passage = passage or ["w0"]
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append(" ".join(text))
    want = set()
    for d, t in enumerate(docs):
        for i, x in items:
            pattern = x.encode().split()
            if (n := distance(pattern, t.encode().split())[0]) <= D.edits(len(pattern)):
                want.add((d, i, n))
    got = {(r, i, n) for r, i, n, *_ in D.Index(items).hits(pa.array(docs))}
    assert got == want and len(want) > 20


def test_spark(spark, make_docs):
    item = " ".join(f"item{i}" for i in range(30))
    edited = item.replace("item7 ", "").replace("item20", "other").upper().replace(" ", ",  ")
    df = make_docs((1, "before " + item + " after"), (2, edited), (3, "nothing of it"), (None, None), (4, ""), (5, item[: len(item) // 2]), (6, item), (6, item)).withColumn("distance", F.lit(1))
    bench = spark.createDataFrame([(9, item, 1), (9, item, 2), (10, None, 3), (None, item, 4), (11, "", 5)], "item_id long, text string, doc_id long")
    for block in (150, 8 << 20):
        got = {r.doc_id: (r.item_id, r.distance) for r in D.contamination(df, bench, block=block).collect()}
        assert got == {1: (9, 0), 2: (9, 2), 6: (9, 0)}
        left = D.clean(df, bench, block=block)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "None"]
    assert D.contamination(df.limit(0), bench).count() == 0 and D.clean(df, bench.limit(0)).count() == 8


def test_query_by_brute_force(spark, sf_dir):
    """Each document and item of the tables against the plain distance, where they share a word in eight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", D.normal(F.col("text")).alias("text")).collect()
    items = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", D.normal(F.col("text")).alias("text")).collect()]
    want = {}
    for d in docs:
        text = d.text.split()
        known = set(text)
        for i, words_ in items:
            k = D.edits(len(words_))
            # every edit spoils at most one word of the item, so fewer shared words can't be within k
            if sum(w in known for w in words_) >= len(words_) - k and (n := distance(words_, text)[0]) <= k:
                want.setdefault(d.doc_id, []).append((i, n))
    got = {r.doc_id: (r.n_items, r.item_ids, r.least_distance) for r in D.op5_decontaminate(spark, sf_dir).collect()}
    assert got == {d: (len(v), sorted(i for i, _ in v), min(n for _, n in v)) for d, v in want.items()} and got


def test_very_long_text_and_clashes(spark, make_docs):
    item = " ".join(f"item{i}" for i in range(20))
    long = "word " * 200000
    df = make_docs((1, long + item), (2, long), (None, item), (None, "fine"))
    for name in ("__normal", "words", "i", "t", "id", "tag", "a.b"):
        df = df.withColumn(name, F.lit(name))
    bench = spark.createDataFrame([(9, item), (10, "other words of some item that is in no text at all")], "item_id long, text string")
    for block in (100, 8 << 20):
        left = D.clean(df, bench, block=block)
        assert left.columns == df.columns and sorted((str(r.doc_id), r["a.b"], r["tag"]) for r in left.collect()) == [("2", "a.b", "tag"), ("None", "a.b", "tag")]
    hit = {r.doc_id: (r.first_word, r.end_word) for r in D.contamination(df, bench, block=100).collect()}
    assert hit == {1: (200000, 200020), None: (0, 20)}
