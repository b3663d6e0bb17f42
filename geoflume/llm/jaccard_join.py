"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Documents with equal sets form
a class; the smallest doc_id represents it. Between representatives:

1. In each run a set picks, at every node of a tree, the shingles whose hash
   with the node is under ``BRANCH`` / size; each picked shingle leads to a child.
   Similar sets share most shingles and, as the hash is shared, most children.
   Sets that meet in a node with at most ``SMALL`` sets are compared there; larger
   nodes go on to their children, down to ``DEPTH``, where whatever meets is
   compared in blocks of ``BLOCK``. Runs are repeated until two sets of the given
   similarity meet with at least the target ``recall``, computed from the tree's
   survival probability in the worst case, where all nodes have full depth.
2. A pair is compared only in the least of the nodes it meets in. First by
   one-permutation minhash sketches, whose margin is wide, to find the documents
   to fetch; then by their shingles, exactly.
3. A comparing task gives each document its number of links found there and one
   link to the least document of its component there, so what is written grows
   with documents, not with pairs.
4. Components over those links, by alternating large-star and small-star steps
   with a checkpoint each, give the classes of near copies.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` in lower case; a text with one to
four words is one shingle of all its words; null and empty texts have no
shingles and are alone in their class; a null doc_id sorts before all others and
such rows are one document for class_id; rows with one doc_id and one text are
one document, reported once per row, with different texts different documents;
other columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import chunks, cut, free, id_back, id_of, keyed, mix, rolling, slice_hash, table, tag_of, word_spans

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
BRANCH, DEPTH, SMALL, BLOCK = 1.5, 3, 4096, 1024
BINS = 128
#: Standard errors that a sketch may be off.
MARGIN = 5.0


def runs_for(recall: float, similarity: float = SIMILARITY, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Runs after which two sets meet with the given probability.

    They share at least ``similarity`` of the larger set, so a node has a number
    of shared children that is Poisson with mean branch * similarity.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-branch * similarity * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingles(data: np.ndarray, off: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    starts, ends, doc = word_spans(data, off)
    h = slice_hash(data, starts, ends)
    rolled = rolling(h, n)
    first = np.searchsorted(doc, np.arange(len(off)))
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix(rolling(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield h[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit for the least hash in each of BINS parts of the hash range; an empty part takes the next full one's."""
    h = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    part = (h >> np.uint64(64 - int(math.log2(BINS)))).astype(np.int64)
    order = np.argsort(h)
    full, at = np.unique(part[order], return_index=True)
    low = h[order][at]
    pos = np.searchsorted(full, np.arange(BINS)) % len(full)
    steps = (full[pos] - np.arange(BINS)) % BINS
    return np.packbits((mix(low[pos] + steps.astype(np.uint64)) & np.uint64(1)).astype(np.uint8))


def paths(s: np.ndarray, seeds: np.ndarray, branch: float = BRANCH, depth: int = DEPTH) -> np.ndarray:
    """Chains of nodes from the root's children on, a row each; 0 where a chain has ended."""
    limit = np.uint64(min(2**64 - 1, int(branch / len(s) * 2**64)))
    chains, nodes, ended = np.zeros((len(seeds), 0), np.uint64), seeds, []
    for level in range(depth):
        width = max(1, (1 << 18) // max(1, len(nodes)))
        ups, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a in range(0, len(s), width):
            h = mix(s[None, a : a + width] ^ nodes[:, None])
            up, col = np.nonzero(h <= limit)
            ups.append(up)
            kids.append(mix(h[up, col] * np.uint64(0x9E3779B97F4A7C15) + nodes[up]) | np.uint64(1))
        up, kid = np.concatenate(ups), np.concatenate(kids)
        if level:
            over = np.delete(chains, up, axis=0)
            ended.append(np.hstack((over, np.zeros((len(over), depth - level), np.uint64))))
        chains = np.hstack((chains[up], kid[:, None]))
        nodes = mix(kid + np.uint64(level + 1))
    return np.vstack([*ended, chains])


def _sets(n: int, runs: int):
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b["id"].to_numpy(), b["tag"].to_numpy()
            for row, data, off in chunks(b["text"]):
                names, sizes, sketches, trees = [], [], [], []
                for s in shingles(data, off, n):
                    sizes.append(len(s))
                    if not len(s):
                        names.append(None), sketches.append(None), trees.append(None)
                        continue
                    names.append(np.array([mix(s).sum(), mix(s * np.uint64(3) + np.uint64(1)).sum()]).tobytes())
                    sketches.append(sketch(s).tobytes())
                    trees.append(paths(s, seeds).tobytes())
                end = row + len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row:end]), pa.array(tags[row:end]), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(trees, pa.binary())],
                    names=["id", "tag", "name", "size", "sketch", "tree"],
                )

    return sets


def _nodes(level: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each representative's nodes of one level, with the node above."""
        for b in batches:
            trees = [np.frombuffer(t, np.int64).reshape(-1, DEPTH) for t in b["tree"].to_pylist()]
            row = np.repeat(np.arange(len(b)), [len(t) for t in trees])
            t = np.concatenate([*trees, np.zeros((0, DEPTH), np.int64)])
            key, up = t[:, level], t[:, max(level - 1, 0)]
            order = np.lexsort((key, row))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(key[order]) != 0) | (np.diff(row[order]) != 0)
            order = order[new & (key[order] != 0)]
            yield pa.RecordBatch.from_arrays([pa.array(b["rep"].to_numpy()[row[order]]), pa.array(up[order]), pa.array(key[order])], names=["rep", "up", "key"])

    return nodes


def leaves(reps: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """rep, key, blocks: the nodes in which each representative is compared."""
    found, large = None, None
    for level in range(DEPTH):
        rows = reps.select("rep", "tree").mapInArrow(_nodes(level), "rep long, up long, key long")
        if large is not None:
            rows = rows.join(large, F.col("up") == F.col("big"), "left_semi")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        fits = sizes if level == DEPTH - 1 else sizes.filter(F.col("n") <= small)
        here = rows.join(fits, "key").select("rep", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        found = here if found is None else found.unionByName(here)
        large = sizes.filter(F.col("n") > small).select(F.col("key").alias("big"))
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for each block pair that a representative takes part in: most have one."""
    own = F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each (key, lo, hi), which come sorted by them."""
    held: list[pa.RecordBatch] = []

    def split(t: pa.Table, last: bool) -> Iterator[pa.Table]:
        k = np.stack([t[c].to_numpy() for c in ("key", "lo", "hi")])
        edges = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        bounds = np.concatenate(([0], edges, [len(t)]))
        for a, b in zip(bounds, bounds[1:] if last else bounds[1:-1]):
            yield t.slice(a, b - a)
        if not last:
            held[:] = t.slice(bounds[-2]).to_batches()

    for b in batches:
        if len(b):
            held.append(b)
            yield from split(pa.Table.from_batches(held), False)
    if held:
        yield from split(pa.Table.from_batches(held), True)


def _open_pairs(t: pa.Table) -> np.ndarray:
    """Which pairs meet nowhere before this group's key, as a matrix; only pairs of this group's two blocks."""
    n, key = len(t), t["key"][0].as_py()
    lists = t["keys"].combine_chunks()
    flat, size = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(n), size)
    early = flat < key
    names, col = np.unique(flat[early], return_inverse=True)
    open_ = np.triu(np.ones((n, n), bool), 1)
    if len(names):
        held = np.zeros((n, len(names)), np.float32)
        held[row[early], col] = 1
        held = held[:, held.sum(0) > 1]
        if held.shape[1]:
            open_ &= (held @ held.T) == 0
    own = t["own"].to_numpy()
    if t["lo"][0].as_py() != t["hi"][0].as_py():
        open_ &= own[:, None] != own[None, :]
    return open_


def _likely(similarity: float):
    bar = (1 + similarity) / 2
    least = BINS * (bar - MARGIN * math.sqrt(bar * (1 - bar) / BINS))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each group that some other member may be similar to."""
        names = ["key", "lo", "hi", "rep", "own", "keys"]
        for t in _groups(batches):
            if len(t) < 2:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8)).reshape(len(t), BINS).astype(np.float32)
            size = t["size"].to_numpy()
            equal = (BINS + (2 * bits - 1) @ (2 * bits - 1).T) / 2
            short = np.minimum(size[:, None], size[None, :])
            near = (equal >= least) | (short < 4 * BINS) & (equal >= BINS * 0.6) | (short < BINS // 2)
            near &= short >= similarity * np.maximum(size[:, None], size[None, :])
            near &= _open_pairs(t)
            member = near.any(0) | near.any(1)
            if member.any():
                yield from t.filter(pa.array(member)).select(names).combine_chunks().to_batches()

    return likely


def _components(linked: np.ndarray) -> np.ndarray:
    """Least index in the component of each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(n: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each group's pairs, by their shingles."""
        for t in _groups(batches):
            t = t.take(pa.array(np.unique(t["rep"].to_numpy(), return_index=True)[1]))  # repeated rows
            m = len(t)
            if m < 2:
                continue
            sets = [s for _, data, off in chunks(t["text"].combine_chunks()) for s in shingles(data, off, n)]
            size = np.array([len(s) for s in sets])
            todo = _open_pairs(t) & (np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]))
            both = np.zeros((m, m), np.int32)
            names, col = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(m), size)
            times = np.bincount(col, minlength=len(names))
            keep = times[col] > 1
            order = np.flatnonzero(times > 1)
            place = np.zeros(len(names), np.int64)
            place[order] = np.arange(len(order))
            row, col = row[keep], place[col[keep]]
            width = max(1, (16 << 20) // (4 * m))
            by = np.argsort(col, kind="stable")
            row, col = row[by], col[by]
            for a in range(0, len(order), width):  # shared shingles, so many at a time
                lo, hi = np.searchsorted(col, (a, a + width))
                held = np.zeros((m, min(width, len(order) - a)), np.float32)
                held[row[lo:hi], col[lo:hi] - a] = 1
                both += (held @ held.T).astype(np.int32)
            union = size[:, None] + size[None, :] - both
            linked = todo & (both >= similarity * union - 1e-9)
            linked |= linked.T
            links = linked.sum(1)
            hit = np.flatnonzero(links)
            if len(hit):
                rep = t["rep"].to_numpy()
                by_rep = np.argsort(rep, kind="stable")
                label = _components(linked[np.ix_(by_rep, by_rep)])
                least = np.empty(m, rep.dtype)
                least[by_rep] = rep[by_rep][label]
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(least[hit])], names=["rep", "links", "least"])

    return verify


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of links a, b."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # large star: a node's larger neighbours go to its least one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        new = large.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").distinct().toDF("a", "b")
        new = cut(new)
        # done when every edge leads from a root to a leaf
        if new.join(new.select(F.col("b").alias("r")), F.col("a") == F.col("r"), "left_semi").isEmpty() and new.groupBy("b").count().filter("count > 1").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def similar(documents: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """id, tag, rep_id, class_id, n_links: a row for each (id, tag)."""
    docs = keyed(documents)
    sets = cut(docs.withColumn("text", F.lower("text")).mapInArrow(_sets(n, runs_for(recall, similarity)), "id long, tag long, name binary, size int, sketch binary, tree binary"))
    place = F.struct("id", "tag")
    named = sets.filter("name is not null")
    classes = named.groupBy("name").agg(F.min(F.struct("id", "tag", "size", "sketch", "tree")).alias("r"))
    classes = cut(classes.select("name", F.xxhash64("r.id", "r.tag").alias("rep"), "r.id", "r.tag", "r.size", "r.sketch", "r.tree"))
    nodes = leaves(classes, small, block)
    lists = nodes.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.collect_set(F.struct("key", "blocks")).alias("at"))
    rows = classes.select("rep", "size", "sketch", "id", "tag").join(lists, "rep")
    dealt = _dealt(rows.select("rep", "size", "sketch", "keys", F.explode("at").alias("x")).select("rep", "size", "sketch", "keys", "x.key", "x.blocks"))
    order = ["key", "lo", "hi"]
    needed = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_likely(similarity), "key long, lo int, hi int, rep long, own int, keys array<long>")
    texts = docs.select(F.xxhash64("id", "tag").alias("rep"), F.lower("text").alias("text"))
    fetched = needed.join(texts, "rep").select("key", "lo", "hi", "rep", "own", "keys", "text")
    links = cut(fetched.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verify(n, similarity), "rep long, links long, least long"))
    count = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    root = components(links.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    known = classes.select("name", "rep", "id", "tag").join(count, "rep", "left").join(root, F.col("rep") == F.col("node"), "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    heads = known.groupBy("root").agg(F.min(place).alias("head"))
    known = known.join(heads, "root").select("name", F.col("id").alias("rep_id"), F.col("head.id").alias("class_id"), F.col("head.tag").alias("class_tag"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.select("id", "tag", "name").join(known, "name", "left")
    return out.select("id", "tag", F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_tag", "tag").alias("class_tag"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(documents: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, rep_id, n_links for each row.

    class_id: the smallest doc_id of all that links lead to. rep_id: the smallest
    doc_id with the same shingles. n_links: representatives with other shingles
    and a similarity of at least the bar.
    """
    out = similar(documents, **options)
    return out.select(*[id_back(F.col(c)).alias(a) for c, a in (("id", "doc_id"), ("class_id", "class_id"), ("rep_id", "rep_id"))], "n_links")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that are the first of their class; of repeated rows one stays."""
    i, t, id, tag, more = free(documents.columns, "i", "t", "id", "tag", "more")
    first = similar(documents, **options).filter("id = class_id and tag = class_tag").select(F.col("id").alias(i), F.col("tag").alias(t)).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("*", id_of(F.col("doc_id")).alias(id), tag_of(text).alias(tag), F.xxhash64(F.lit(1), text).alias(more))  # 128 bits, as rows go by them
    rows = rows.join(first, (F.col(id) == F.col(i)) & (F.col(tag) == F.col(t)), "left_semi")
    return rows.dropDuplicates([id, tag, more]).drop(id, tag, more)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE: dict[str, str] = {}
