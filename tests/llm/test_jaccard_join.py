import random
import re

import pytest
from geoflume.llm import jaccard_join as J


def shingle(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, bar=0.8):
    """doc_id -> (class_id, rep_id, n_links), for rows with doc_ids of their own."""
    sets = {d: shingle(t) for d, t in rows}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d] or d, d)
    reps = sorted(rep.values())
    index, root, links = {}, {d: d for d in sets}, {d: 0 for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in reps:
        near = {b for s in sets[a] for b in index.get(s, ())}
        for b in near:
            both = len(sets[a] & sets[b])
            if both >= bar * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
        for s in sets[a]:
            index.setdefault(s, set()).add(a)
    return {d: (find(r), r, links[r]) for d in sets for r in [rep[sets[d] or d]]}


def check(df, rows, **options):
    want = brute(rows)
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_links) for r in J.jaccard_join(df, **options).collect()}
    assert len(got) == len(rows)
    wrong = [d for d in want if got[d] != want[d]]
    return want, wrong


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, wrong = check(df, [(r.doc_id, r.text) for r in df.collect()])
    assert not wrong and sum(v[2] for v in want.values()) > 0


@pytest.mark.parametrize("small, block", [(256, 1024), (4, 7), (1, 3)])
def test_groups_of_near_copies(make_docs, small, block):
    """A hot group, chains of near copies, and a passage in every document; small nodes, deep nodes, and blocks."""
    rng = random.Random(small)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(40))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(120)] = word()
        rows.append((i, " ".join(text)))
    for i in range(60, 140):
        rows.append((i, passage + " " + " ".join(word() for _ in range(rng.randint(0, 80)))))
    chain = [word() for _ in range(100)]
    for i in range(140, 150):
        chain[rng.randrange(100)] = word()
        rows.append((i, " ".join(chain)))
    rows += [(150, rows[0][1]), (151, ""), (152, None), (153, "a b c"), (154, "A b  c"), (155, "a b d")]
    rng.shuffle(rows)
    want, wrong = check(make_docs(*rows), rows, small=small, block=block)
    assert len(wrong) <= 0.02 * len(rows), [(d, want[d]) for d in wrong]
    assert max(v[2] for v in want.values()) > 20


def test_edges(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    df = make_docs((None, text), (1, text + " x"), (2, text), (2, text), (3, None), (3, ""), (4, "other"), (4, text.upper()))
    out = sorted(((r.doc_id, r.class_id, r.rep_id, r.n_links) for r in J.jaccard_join(df.withColumn("name", df.lang).withColumn("size", df.n_chars)).collect()), key=repr)
    assert out == sorted([(None, None, None, 1), (1, None, 1, 1), (2, None, None, 1), (2, None, None, 1), (3, 3, 3, 0), (3, 3, 3, 0), (4, 4, 4, 0), (4, None, None, 1)], key=repr)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", text), ("3", kept.filter("doc_id = 3").first().text), ("4", "other")])
    assert J.jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in J.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_runs():
    assert J.runs_for(0.9) < J.runs_for(0.999) == 11


def test_clashing_columns_and_very_long_texts(make_docs):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(40000))
    df = make_docs((1, long), (2, long + " tail"), (3, "x " * 100000), (None, "a b c"), (None, "a b c"))
    for name in ("__id", "__tag", "__i", "id", "tag", "i", "t", "more", "rep", "a.b"):
        df = df.withColumn(name, F.lit(name))
    out = J.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r["tag"], r["a.b"]) for r in out.collect()) == [("1", "tag", "a.b"), ("3", "tag", "a.b"), ("None", "tag", "a.b")]
