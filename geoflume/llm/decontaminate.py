"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are read as lower-cased words of letters and digits. An
item of n words may differ from a passage by k = n * ``budget`` word edits
(rounded down; items under ``EXACT`` words by none). The item is split into
k + 1 pieces; a passage within k edits holds at least one piece unchanged, so
every passage is near an exact hit of a piece. Hits are found with one hash
lookup a word and piece length, and verified with Myers' bit-parallel distance,
over words, in the part of the text where the item can lie.

The items are a stated query set: they reach the tasks in blocks of about
``BLOCK`` characters, however many there are; the driver holds one block at a time,
as each block's hits are checkpointed before the next. Documents are not shuffled;
only the hits are, and for items of more than one block clean() joins the documents
with the keys of those that were hit.

Defined cases: null and empty texts and items hold nothing; a null doc_id stays
null; documents are judged row by row, and hits of rows with the same doc_id are
reported together; repeated items count once; an item of one word is found in every
document with that word; other columns have no effect; empty tables give no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import chunks, cut, free, id_back, id_of, keep_rows, rolling, slice_hash, table, word_spans

BUDGET, EXACT, BLOCK = 0.2, 8, 8 << 20
_BITS = 20


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def edits(n: int, budget: float = BUDGET) -> int:
    return int(n * budget) if n >= EXACT else 0


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of k + 1 pieces of n words."""
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part."""
    eq: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        eq[w] |= 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The pieces of a block of items, by length."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        self.items = [(i, t.encode().split()) for i, t in items]
        self.items = [(i, w, edits(len(w), budget)) for i, w in self.items if w]
        by_length: dict[int, list] = defaultdict(list)
        for at, (_, words, k) in enumerate(self.items):
            for start, n in pieces(len(words), k):
                by_length[n].append((at, start, words[start : start + n]))
        self.by_length = {}
        for n, found in by_length.items():
            data = np.frombuffer(b" ".join(b" ".join(w) for _, _, w in found), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            h = rolling(slice_hash(data, starts, ends), n)[::n]
            table: dict[int, list] = defaultdict(list)
            for x, (at, start, _) in zip(h.tolist(), found):
                table[x].append((at, start))
            seen = np.zeros(1 << _BITS, bool)
            seen[h & np.uint64((1 << _BITS) - 1)] = True
            self.by_length[n] = (seen, dict(table))

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, end word) of the best passage of each item in each row."""
        for row, data, off in chunks(texts):
            starts, ends, doc = word_spans(data, off)
            if not len(starts):
                continue
            words = slice_hash(data, starts, ends)
            found: dict[tuple[int, int], set[int]] = defaultdict(set)
            for n, (seen, table) in self.by_length.items():
                h = rolling(words, n)
                at = np.flatnonzero(seen[h & np.uint64((1 << _BITS) - 1)])
                at = at[doc[at] == doc[at + n - 1]]
                for p, x in zip(at.tolist(), h[at].tolist()):
                    for item, start in table.get(x, ()):
                        found[int(doc[p]), item].add(p - start)
            whole: dict[int, tuple[int, list[bytes]]] = {}
            for (d, item), places in sorted(found.items()):
                if d not in whole:
                    whole = {d: (int(np.searchsorted(doc, d)), bytes(data[off[d] : off[d + 1]]).split())}
                first, text = whole[d]
                item_id, words_, k = self.items[item]
                best, done = None, -1
                for p in sorted(places):
                    lo, hi = max(0, p - first - k), min(len(text), p - first + len(words_) + k)
                    if hi <= done:
                        continue
                    done = hi
                    distance, end = myers(words_, text[lo:hi])
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, max(lo, lo + end - len(words_)), lo + end)
                if best:
                    yield row + d, item_id, *best


def _blocks(benchmark: DataFrame, block: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks, and each block's items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal(F.col("text")).alias("text")).filter("item_id is not null and text <> ''").distinct()
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block) + 1
    if n > 1:
        items = cut(items)

    def each() -> Iterator[list[tuple[int, str]]]:
        for b in range(n):
            own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
            yield [(r.item_id, r.text) for r in own.orderBy("item_id", "text").toLocalIterator()]

    return n, each()


def _finder(items: list[tuple[int, str]], budget: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, budget)
        for b in batches:
            ids, tags = b["id"].to_numpy(), b["tag"].to_numpy()
            rows = [(ids[r], tags[r], *x) for r, *x in index.hits(b["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names=["id", "tag", "item_id", "distance", "first_word", "end_word"])

    return find


def _hits(documents: DataFrame, benchmark: DataFrame, budget: float, block: int) -> DataFrame:
    """id, tag, item_id, distance, first_word, end_word for each row and item. tag is of the whole text."""
    docs = documents.select(id_of(F.col("doc_id")).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag"), normal(F.col("text")).alias("text"))
    out, (n, blocks) = None, _blocks(benchmark, block)
    for items in blocks:
        found = docs.mapInArrow(_finder(items, budget), "id long, tag long, item_id long, distance long, first_word long, end_word long")
        found = found if n == 1 else cut(found)
        out = found if out is None else out.unionByName(found)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, first_word, end_word: the best passage of each item in each document."""
    best = _hits(documents, benchmark, budget, block).groupBy("id", "item_id").agg(F.min(F.struct("distance", "first_word", "end_word")).alias("best"))
    return best.select(id_back(F.col("id")).alias("doc_id"), "item_id", "best.*")


def clean(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""
    n, blocks = _blocks(benchmark, block)
    if n == 1:
        items = next(blocks)

        def keep():
            index = Index(items, budget)

            def passes(texts: pa.Array) -> np.ndarray:
                ok = np.ones(len(texts), bool)
                ok[[r for r, *_ in index.hits(texts)]] = False
                return ok

            return passes

        return keep_rows(documents, normal(F.col("text")), keep)
    text = F.coalesce(F.col("text"), F.lit(""))
    i, t, id, tag = free(documents.columns, "i", "t", "id", "tag")
    hit = cut(_hits(documents, benchmark, budget, block).select("id", "tag").distinct().toDF(id, tag))
    rows = documents.select("*", id_of(F.col("doc_id")).alias(i), F.xxhash64(text).alias(t))
    return rows.join(hit, (F.col(i) == F.col(id)) & (F.col(t) == F.col(tag)), "left_anti").drop(i, t)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_items, item_ids, least_distance of each contaminated document."""
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("distance").alias("least_distance"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
