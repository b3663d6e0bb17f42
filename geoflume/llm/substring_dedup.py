"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the least
hash among its ``m``-word pieces. Consecutive windows with one minimiser form a
super-k-mer. Equal windows have equal minimisers, so

1. a scan lists the super-k-mers (minimiser, place, length) without their words,
   and those whose minimiser occurs at one place in the corpus are settled: they
   repeat nothing;
2. the others travel as one packed string each to the bucket of their minimiser,
   where windows are sorted by hash and equal neighbours compared word by word;
3. the repeated spans come back to their documents by key.

Minimisers with more than ``HOT`` super-k-mers travel as single windows, dealt by
the hash of the whole window, so one frequent passage doesn't fill one bucket.
Equal strings of one task are merged before the shuffle: the later ones are
repeats as a whole and only their spans travel on.

Defined cases: null and empty texts have no words; a null doc_id sorts before
all others; rows with the same doc_id and text are one document, reported once
per row; rows with the same doc_id and different texts are different documents
in a fixed order; other columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import SPACE, chunks, cut, id_back, keyed, mix, rolling, slice_hash, table, word_spans

K, M = 20, 5
#: Super-k-mers of one minimiser from which its windows travel one by one.
HOT = 2000
#: Bytes of packed strings that a bucket task sorts at a time, but for whole minimisers.
SORT_BYTES = 3 << 20


def _least(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width and len(h):
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run; same[i] says that i belongs with i - 1."""
    first = np.flatnonzero(~same)
    return first, np.diff(np.append(first, len(same)))


def _cuts(k: int, m: int):
    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b["id"].to_numpy(), b["tag"].to_numpy()
            for row, data, off in chunks(b["text"]):
                starts, ends, doc = word_spans(data, off)
                if len(starts) < k:
                    continue
                pieces, width = rolling(slice_hash(data, starts, ends), m), k - m + 1
                least = _least(pieces, width)
                at = np.flatnonzero(doc[: len(least)] == doc[k - 1 :])
                if not len(at):
                    continue
                mini, own = least[at], doc[at]
                same = np.zeros(len(at), bool)
                same[1:] = (mini[1:] == mini[:-1]) & (own[1:] == own[:-1])
                first, n = _runs(same)
                here = np.zeros(len(least), np.int16)  # places of each window's minimiser inside it
                for j in range(width):
                    here += pieces[j : j + len(least)] == least
                places = np.where((n > width) | (np.maximum.reduceat(here[at], first) > 1), 2, 1)
                word0 = np.searchsorted(doc, own[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row + own[first]]),
                        pa.array(tags[row + own[first]]),
                        pa.array(mini[first].view(np.int64)),
                        pa.array((at[first] - word0).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(places.astype(np.int32)),
                    ],
                    names=["id", "tag", "mini", "start", "n", "places"],
                )

    return cuts


def _pack(k: int):
    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "id", "tag", "start", "n", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[bytes, tuple] = {}
            rows: list[tuple] = []

            def put(key: int, id: int, tag: int, start: int, n: int, packed: bytes) -> None:
                new, old = (id, tag, start, n, key), best.get(packed)
                if old is None or new[:3] < old[:3]:
                    best[packed], new = new, old
                if new is not None and new[:3] != best[packed][:3]:  # equal places are a repeated row's
                    rows.append((new[0], *new[:4], None))

            size = 0
            for id, tag, text, cuts in zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["cuts"].to_pylist()):
                words = text.split()
                for c in cuts:
                    s, n = c["start"], c["n"]
                    if c["hot"]:
                        for i in range(s, s + n):
                            packed = b" ".join(words[i : i + k]) + b" "
                            put(xxhash.xxh64_intdigest(packed) - 2**63, id, tag, i, 1, packed)
                            size += len(packed)
                    else:
                        packed = b" ".join(words[s : s + n + k - 1]) + b" "
                        put(c["mini"], id, tag, s, n, packed)
                        size += len(packed)
                if size > 32 << 20:  # bounds what one task holds
                    yield out(rows + [(v[4], *v[:4], p) for p, v in best.items()])
                    best.clear()
                    rows.clear()
                    size = 0
            yield out(rows + [(v[4], *v[:4], p) for p, v in best.items()])

    return pack


def _repeats(t: pa.Table, k: int) -> pa.RecordBatch:
    """Spans of words in repeated windows, for packed strings that include every string of their keys."""
    ids, tags, start = (t[c].to_numpy() for c in ("id", "tag", "start"))
    packed = t["packed"].combine_chunks()
    n = len(packed)
    off = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    stops = np.flatnonzero(SPACE[data]) + 1
    bounds = np.concatenate(([0], stops)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.searchsorted(off, bounds[:-1], "right") - 1
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    h = rolling(mix(code.astype(np.uint64) + np.uint64(1)), k)[at]
    own = row[at]
    pos = start[own] + (at - np.searchsorted(row, own))
    order = np.lexsort((pos, tags[own], ids[own], h))
    hs, seq = h[order], at[order]
    same = np.zeros(len(order), bool)
    same[1:] = hs[1:] == hs[:-1]
    check = np.flatnonzero(same)
    differs = np.zeros(len(check), bool)
    for j in range(k):
        differs |= code[seq[check] + j] != code[seq[check - 1] + j]
    if differs.any():  # hashes that met: order their windows by the words themselves
        hit = np.flatnonzero(np.isin(hs, hs[check[differs]]))
        exact = sorted(hit, key=lambda i: (hs[i], *code[seq[i] : seq[i] + k], i))
        order[hit] = order[exact]
        seq = at[order]
        same[check] = True
        for i in check:
            same[i] = (code[seq[i] : seq[i] + k] == code[seq[i - 1] : seq[i - 1] + k]).all()
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    o, a, b = own[order], order, order[head]
    later = (ids[o] != ids[own[b]]) | (tags[o] != tags[own[b]]) | (pos[a] != pos[b])
    dup = np.zeros(len(at), bool)
    dup[order] = later
    hit = np.flatnonzero(dup)
    joined = np.zeros(len(hit), bool)
    joined[1:] = (np.diff(hit) == 1) & (own[hit[1:]] == own[hit[:-1]])
    first, length = _runs(joined) if len(hit) else (hit, hit)
    f = hit[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[own[f]]), pa.array(tags[own[f]]), pa.array(pos[f].astype(np.int32)), pa.array((pos[f] + length + k - 1).astype(np.int32))],
        names=["id", "tag", "lo", "hi"],
    )


def _count(k: int):
    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        known = t.filter(t["packed"].is_null())
        if len(known):
            lo = known["start"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(known["id"].to_numpy()), pa.array(known["tag"].to_numpy()), pa.array(lo), pa.array((lo + known["n"].to_numpy() + k - 1).astype(np.int32))],
                names=["id", "tag", "lo", "hi"],
            )
        t = t.filter(t["packed"].is_valid())
        if len(t):
            yield _repeats(t, k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += b.nbytes
            if size < SORT_BYTES:
                continue
            keys = b["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # rows come sorted by key
            if last == 0 and len(held) > 1 and held[-2]["key"][-1].as_py() == int(keys[0]) or last == 0 and len(held) == 1:
                continue
            held[-1] = b.slice(0, last)
            yield from whole(pa.Table.from_batches(held))
            held, size = [b.slice(last)], 0
        if held:
            yield from whole(pa.Table.from_batches(held))

    return count


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, gone, digest, kept = [], [], [], []
        for text, runs in zip(b["text"].cast(pa.binary()).to_pylist(), b["runs"].to_pylist()):
            words = text.split()
            total.append(len(words))
            if runs:
                drop = np.zeros(len(words) + 1, np.int32)
                np.add.at(drop, [r["lo"] for r in runs], 1)
                np.add.at(drop, [r["hi"] for r in runs], -1)
                keep = np.cumsum(drop)[:-1] == 0
                words = [w for w, x in zip(words, keep.tolist()) if x]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b["id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def repeating(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """id, tag, cuts: the super-k-mers (start, n, mini, hot) of each document whose minimiser occurs at two places or more."""
    cuts = docs.mapInArrow(_cuts(k, m), "id long, tag long, mini long, start int, n int, places int")
    # written apart and always merged, so that the adaptive plan may split a frequent minimiser's rows, at any size
    often = cut(cuts.groupBy("mini").agg(F.sum("places").alias("often")).filter("often > 1")).hint("merge")
    return cuts.join(often, "mini").groupBy("id", "tag").agg(F.collect_set(F.struct("start", "n", "mini", (F.col("often") > hot).alias("hot"))).alias("cuts"))


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """id, tag, lo, hi: spans of words that lie in windows with an earlier equal window (docs as from keyed())."""
    packed = docs.join(repeating(docs, k, m, hot), ["id", "tag"]).select("id", "tag", "text", "cuts").mapInArrow(_pack(k), "key long, id long, tag long, start int, n int, packed binary")
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(_count(k), "id long, tag long, lo int, hi int")


def substring_dedup(documents: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""
    docs = keyed(documents)
    runs = repeated_spans(docs, k, m, hot).groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    out = docs.join(runs, ["id", "tag"], "left").select("id", "text", "runs").mapInArrow(_finish, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(id_back(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
#: For tables whose doc_ids are different and not null.
ORACLE = {
    "op1_substring_dedup": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {K - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {K - 2})) AS i FROM docs WHERE len(words) >= {K})
),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
),
gone AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + {K})) AS pos FROM again)
),
every AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs
),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS kept, count(g.pos) AS n_removed
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
}
