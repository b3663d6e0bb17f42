"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each category's model is a
logistic regression on hashed words and word beginnings and on the probabilities
of the categories before it; in training these are out-of-fold predictions, so a
later model sees the errors that an earlier one makes on texts new to it. Features
are chosen by chi-square, for out-of-fold predictions within the other folds.

The models are fitted on the driver from at most ``MAX_TRAIN`` labelled rows,
``RARE`` of them at most with the last category set, chosen by a hash of the
doc_id; only their hashed features are collected, one row a doc_id. Scoring is one scan without a
shuffle. The given labels know one toxicity category, so the query's chain is
low quality, then toxic; the operator takes any list of 0/1 columns.

Defined cases: null and empty texts have no features and get the models' base
rate; a null doc_id stays null; labels with a null are left out, of repeated
labels of a document the largest counts, of rows with one labelled doc_id the
least text; a category without both values among
the labels has its share of ones as probability everywhere; repeated rows are
scored each; other columns have no effect, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import chunks, keep_rows, slice_hash, table, word_spans
from geoflume.llm.decontaminate import normal

MAX_TRAIN, RARE, FOLDS, BITS, PREFIX = 8000, 3000, 4, 20, 4
#: Features of each category at most, their least chi-square, and the models' ridge.
SELECTED, LEAST_CHI, RIDGE = 200, 40.0, 0.3
THRESHOLD = 0.5


def cells(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature), each pair once. only: features to keep, as a mask."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, data, off in chunks(texts):
        starts, ends, doc = word_spans(data, off)
        if not len(starts):
            continue
        long = ends - starts > PREFIX
        h = np.concatenate((slice_hash(data, starts, ends), ~slice_hash(data, starts[long], starts[long] + PREFIX)))
        at, row = (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate((doc, doc[long]))
        if only is not None:
            at, row = at[only[at]], row[only[at]]
        pair = np.unique(row << BITS | at)
        rows.append(first + (pair >> BITS))
        found.append(pair & ((1 << BITS) - 1))
    return np.concatenate(rows), np.concatenate(found)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """Logistic regression on sparse 0/1 features and a few dense columns, by Newton steps with a ridge."""

    def fit(self, rows: np.ndarray, cols: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> Linear:
        n, share = len(y), (y.sum() + 0.5) / (len(y) + 1)
        self.w, self.v, self.b = np.zeros(width), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        x = np.zeros((n, width + dense.shape[1] + 1))
        x[rows, cols] = 1
        x[:, width:-1], x[:, -1] = dense, 1
        beta, weight = np.append(np.zeros(x.shape[1] - 1), self.b), np.full(x.shape[1], ridge)
        weight[-1] = 1e-9
        for _ in range(steps):
            p = _sigmoid(x @ beta)
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(weight), x.T @ (p - y) + weight * beta)
            beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.v, self.b = beta[:width], beta[width:-1], float(beta[-1])
        return self

    def z(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.w[cols], minlength=len(dense)) + dense @ self.v + self.b


class Chain:
    """index: the selected features as positions, else -1; models: one a category."""

    def __init__(self, index: np.ndarray, models: list[Linear]):
        self.index, self.models, self.only = index, models, index >= 0

    def predict(self, texts: pa.Array) -> np.ndarray:
        rows, found = cells(texts, self.only)
        cols, p = self.index[found], np.zeros((len(texts), 0))
        for m in self.models:
            p = np.column_stack((p, _sigmoid(m.z(rows, cols, p))))
        return p


def _choose(rows: np.ndarray, found: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """The n features of each category that tell its values apart best, by chi-square."""
    best: set[int] = set()
    of_all = np.bincount(found, minlength=1 << BITS).astype(float)
    for y in labels.T:
        share = y.mean() if len(y) else 0.0
        expected = of_all * share
        chi = (np.bincount(found[y[rows] == 1], minlength=1 << BITS) - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
        top = np.argsort(-chi, kind="stable")[:n]
        best |= set(top[chi[top] >= LEAST_CHI].tolist())
    index = np.full(1 << BITS, -1, np.int32)
    index[sorted(best)] = np.arange(len(best))
    return index


def _picked(index: np.ndarray, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of the features that index selects, and their number."""
    keep = index[found] >= 0
    return rows[keep], index[found[keep]], int(index.max()) + 1


def out_of_fold(rows: np.ndarray, found: np.ndarray, labels: np.ndarray, folds: int = FOLDS, selected: int = SELECTED) -> np.ndarray:
    """Each category's probability for each row, from features and models that haven't seen the row's fold."""
    n = len(labels)
    fold, out = np.arange(n) % folds, np.zeros(labels.shape)
    parts = []
    for f in range(min(folds, n)):
        train = fold != f
        use = train[rows]
        place = np.cumsum(train) - 1
        parts.append((train, use, place, _choose(place[rows[use]], found[use], labels[train], selected)))
    for c, y in enumerate(labels.T.astype(float)):
        before = out[:, :c].copy()
        for train, use, place, index in parts:
            r, cols, width = _picked(index, rows, found)
            t, tc, _ = _picked(index, rows[use], found[use])
            part = Linear().fit(place[t], tc, width, before[train], y[train])
            out[~train, c] = _sigmoid(part.z(r, cols, before))[~train]
    return out


def fit_chain(rows: np.ndarray, found: np.ndarray, labels: np.ndarray, folds: int = FOLDS, selected: int = SELECTED) -> Chain:
    """labels: 0/1, a column for each category in the chain's order."""
    index = _choose(rows, found, labels, selected)
    before = out_of_fold(rows, found, labels, folds, selected)
    rows, cols, width = _picked(index, rows, found)
    return Chain(index, [Linear().fit(rows, cols, width, before[:, :c], y) for c, y in enumerate(labels.T.astype(float))])


def train(documents: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN, rare: int = RARE) -> Chain:
    """The chain for 0/1 columns of labels, in the given order."""
    known = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    ones = known.filter(F.col(categories[-1]) == 1).orderBy(*by).limit(rare)
    sample = ones.unionByName(known.filter(F.col(categories[-1]) != 1).orderBy(*by).limit(max_train - rare))
    # at most max_train rows of integers
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", *categories).agg(normal(F.min("text")).alias("text"))  # however often a doc_id is repeated

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = cells(b["text"])
            ends = np.searchsorted(rows, np.arange(len(b) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[b[c] for c in categories], lists], names=["doc_id", *categories, "cells"])

    schema = "doc_id long, " + ", ".join(f"`{c}` int" for c in categories) + ", cells array<int>"
    got = texts.mapInArrow(extract, schema).toArrow().sort_by("doc_id").combine_chunks()
    y = np.column_stack([got[c].to_numpy() for c in categories]).astype(np.int8) if len(got) else np.zeros((0, len(categories)), np.int8)
    lists = got["cells"].combine_chunks() if len(got) else None
    if lists is None or not len(lists):
        rows = found = np.zeros(0, np.int64)
    else:
        rows = np.repeat(np.arange(len(y)), pa.compute.list_value_length(lists).to_numpy())
        found = lists.flatten().to_numpy().astype(np.int64)
    return fit_chain(rows, found, y)


def score(documents: DataFrame, chain: Chain, categories: list[str]) -> DataFrame:
    """doc_id and p_<category>."""
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.round(chain.predict(b["text"]), 6)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, pa.float64()) for c in p.T]], names=["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in names))


def accepted(documents: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose last category stays under the threshold."""
    return keep_rows(documents, normal(F.col("text")), lambda: lambda texts: chain.predict(texts)[:, -1] < threshold)


CATEGORIES = ["low_quality", "toxic"]


def label_table(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic (whether it is rejected)."""
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, label_table(table(spark, sf_dir, "labels")), CATEGORIES)
    return score(docs, chain, CATEGORIES).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
