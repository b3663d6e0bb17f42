import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoflume.llm import toxicity as T


def test_held_out(spark, sf_dir):
    """Fitted on the labels of even documents, the chain finds the toxic ones among the odd."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = T.train(docs, T.label_table(labels.filter("doc_id % 2 = 0")), T.CATEGORIES)
    odd = T.score(docs.filter("doc_id % 2 = 1"), chain, T.CATEGORIES).join(labels, "doc_id").toPandas()
    said = odd.p_toxic >= T.THRESHOLD
    assert len(odd) > 500 and odd.toxic.sum() > 50
    assert said[odd.toxic == 1].mean() > 0.8 and said[odd.toxic == 0].mean() < 0.01


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    n = 1200
    first = rng.integers(0, 2, n)
    second = first * (rng.random(n) < 0.97)
    texts = pa.array([f"word{'alpha' if x else 'beta'} other{i % 7}" for i, x in enumerate(first)])
    rows, found = T.cells(texts)
    chain = T.fit_chain(rows, found, np.column_stack((first, second)))
    p = chain.predict(texts)
    assert p.shape == (n, 2) and ((p[:, 0] > 0.5) == first).all() and chain.models[1].v[0] > 0
    assert (p[first == 1, 1] > 0.5).all() and (p[first == 0, 1] < 0.5).all()


def test_edges(spark, make_docs):
    df = make_docs((None, None), (1, ""), (2, "moron idiot"), (2, "moron idiot"), (3, "fine words"), (4, "x " * 50000)).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(2, 1, 1), (2, 1, 0), (3, 1, 0), (1, 1, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.train(df, T.label_table(labels), T.CATEGORIES)
    out = T.score(df, chain, T.CATEGORIES).collect()
    assert len(out) == 6 and all(0 <= r.p_toxic <= 1 for r in out)
    assert T.accepted(df, chain).columns == df.columns
    assert T.score(df.limit(0), chain, T.CATEGORIES).count() == 0
    none = T.train(df.limit(0), T.label_table(labels), T.CATEGORIES)
    assert T.score(df, none, T.CATEGORIES).count() == 6


def test_out_of_fold_probabilities_have_not_seen_their_fold():
    """Words that each stand in one text only say nothing of it; a feature choice or model that has seen it would say all."""
    rng = np.random.default_rng(1)
    n = 400
    y = rng.integers(0, 2, n)
    texts = pa.array([" ".join(f"u{i}x{j}" for j in range(6)) + (" sign" if y[i] and i % 3 else "") for i in range(n)])
    rows, found = T.cells(texts)
    p = T.out_of_fold(rows, found, y[:, None])
    known = np.array([x.as_py().endswith("sign") for x in texts])
    assert (p[known, 0] > 0.9).mean() > 0.9
    assert abs(p[~known & (y == 1), 0].mean() - p[~known & (y == 0), 0].mean()) < 0.1
    # the same, fold by fold and by hand
    labels = np.column_stack((y, y ^ (rng.random(n) < 0.1)))
    want = np.zeros((n, 2))
    for c in range(2):
        for f in range(T.FOLDS):
            test = np.arange(n) % T.FOLDS == f
            r, w = T.cells(texts.filter(pa.array(~test)))
            index = T._choose(r, w, labels[~test], T.SELECTED)
            keep = index[w] >= 0
            m = T.Linear().fit(r[keep], index[w[keep]], int(index.max()) + 1, want[~test, :c], labels[~test, c].astype(float))
            r, w = T.cells(texts.filter(pa.array(test)))
            keep = index[w] >= 0
            z = np.array([m.b + m.w[index[w[keep & (r == i)]]].sum() + (want[test][i, :c] * m.v).sum() for i in range(test.sum())])
            want[test, c] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    assert np.allclose(T.out_of_fold(rows, found, labels), want)


def test_scores_by_brute_force(spark, sf_dir):
    """Each document's probabilities from the models' weights, word by word."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = T.train(docs, T.label_table(labels), T.CATEGORIES)
    got = {r.doc_id: r for r in T.op6_toxicity(spark, sf_dir).collect()}
    texts = docs.select("doc_id", T.normal(F.col("text")).alias("text")).collect()
    assert len(got) == len(texts)
    for r in texts:
        words = {w.encode() for w in r.text.split(" ") if w}
        cells = set()
        for w in words:
            cells |= {int(T.slice_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> (64 - T.BITS)}
            if len(w) > T.PREFIX:
                cells |= {int(~T.slice_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([T.PREFIX]))[0]) >> (64 - T.BITS)}
        p = []
        for m in chain.models:
            z = m.b + sum(m.w[chain.index[c]] for c in cells if chain.index[c] >= 0) + sum(a * b for a, b in zip(p, m.v))
            p.append(1 / (1 + np.exp(-z)))
        assert abs(p[0] - got[r.doc_id].p_low_quality) < 2e-6 and abs(p[1] - got[r.doc_id].p_toxic) < 2e-6


def test_hot_doc_id_and_clashes(spark, make_docs):
    df = make_docs(*[(2, f"moron {i % 3}") for i in range(300)], (3, "fine"), (None, "x")).withColumn("__normal", F.lit("n")).withColumn("words", F.lit("w")).withColumn("a.b", F.lit(1))
    chain = T.train(df, T.label_table(spark.createDataFrame([(2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")), T.CATEGORIES)
    out = T.accepted(df, chain)
    assert out.columns == df.columns and all(r["words"] == "w" and r["__normal"] == "n" for r in out.collect())
    assert T.accepted(df.limit(0), chain).count() == 0
