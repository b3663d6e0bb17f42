"""Hard negatives by an exact kNN join over Voronoi cells.

Scores are inner products of whole-number vectors. A row gets one more entry that
makes all rows as long as the longest, an anchor gets 0 there: then a higher score is
a smaller distance, and the triangle inequality holds. Pivots (a bounded, documented
number of rows) cut the space into cells; an anchor belongs to its nearest pivot.

``best`` finds, for many queries, the first k rows of a score window and of the same
or another label. It first joins each cell's anchors with the rows of their own cell.
What that finds bounds how low a row may score and still count, so each cell of
anchors needs only the rows within a ring around its pivot: in the second join a row
is copied to the cells whose ring it lies in, and to no other. Both joins are exact
blocks: at most ``PER_GROUP`` queries of a cell meet about ``PER_BLOCK`` rows in a task,
which keeps k a query; a window over those gives the answer. No pair of rows leaves a
task otherwise, cells are cut into groups and blocks by count, and the number of pivots
follows the anchors', so that copies are few where rings prune nothing (vectors without
clusters: then each row is copied to each cell once, the whole job).

op12 asks twice: for each anchor's positives, then for each positive's negatives.

Defined cases: null vec_ids, labels and vectors and vectors with null or non-finite
entries take no part; entries that a vector lacks beside another count as 0; entries
beyond 2**27 are held there, so scores fit a long; rows of the anchor's own vec_id are
none of its positives or negatives; rows of one vec_id with equal scores count once,
others each for itself; repeated anchors (equal vec_id, label and vector) count once;
an anchor without positives, or a positive whose window is empty, gives no rows; other
columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.llm._common import cut, table
from geoflume.llm._vectors import doubles, floored, is_valid, matrix

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Queries of a cell in a task, rows in a task (about), rows in a packed chunk, and the most pivots.
PER_GROUP, PER_BLOCK, CHUNK, MAX_PIVOTS = 2048, 1 << 16, 1024, 256
_MOST = 1 << 27
_NONE, _ALL = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Cells:
    """Pivots with the added entry; longest: the largest squared length; n: the number of rows."""

    pivots: np.ndarray
    longest: int
    n: int
    dim: int

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each vector to each pivot."""
        x = v.astype(float)
        own = (x * x).sum(1)
        extra = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.longest - own, 0))
        x = np.hstack((x, extra[:, None]))
        square = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    @property
    def slack(self) -> float:
        """Above what float64 may lose in a distance."""
        return 1e-6 * (1 + self.longest**0.5)


def rows_of(embeddings: DataFrame) -> DataFrame:
    """id, label, v of the rows that take part."""
    ok = is_valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    return embeddings.filter(ok).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), doubles(F.col("embedding")).alias("v"))


def whole(lists: pa.Array, scale: float, dim: int | None = None) -> np.ndarray:
    return floored(matrix(lists, dim), scale, _MOST)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def _pack(v: np.ndarray) -> bytes:
    """The first byte says how wide the whole numbers are."""
    top = int(np.abs(v).max(initial=0))
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k - 1))
    return bytes([kind]) + v.astype(f"<i{kind}").tobytes()


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def cells(rows: DataFrame, anchors: int, scale: float = SCALE) -> Cells:
    """The longest row's length by an aggregate, and pivots: the rows whose ids have the smallest hashes, one for every 128 anchors."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, dim = 0, 0, 0
        for b in batches:
            v = whole(b["v"], scale)
            n, dim = n + len(v), max(dim, v.shape[1])
            if v.size:
                top = max(top, int((v * v).sum(1).max()))
        yield pa.RecordBatch.from_pydict({"n": [n], "top": [top], "dim": [dim]}, pa.schema([("n", pa.int64()), ("top", pa.int64()), ("dim", pa.int64())]))

    r = rows.select("v").mapInArrow(measure, "n long, top long, dim long").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("dim").alias("dim")).first()
    n, top, dim = r.n or 0, r.top or 0, r.dim or 0
    take = max(1, min(MAX_PIVOTS, anchors // 128))
    found = rows.orderBy(F.xxhash64("id", "v"), "id").limit(take).select("v").toArrow()["v"].combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    v = np.unique(whole(found, scale, dim), axis=0).astype(float) if n else np.zeros((0, dim))
    return Cells(np.hstack((v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None])), top, n, dim)


def anchors_of(rows: DataFrame, by: Cells, every: int, scale: float = SCALE) -> DataFrame:
    """id, tag, label, vec, cell, far: each anchor once, its nearest pivot and the distance to it."""
    chosen = rows.filter(F.col("id") % every == 0).withColumn("tag", F.xxhash64("label", "v")).dropDuplicates(["id", "tag"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = whole(b["v"], scale, by.dim)
            d = by.distances(v, True)
            cell = d.argmin(1)
            cols = [b["id"], b["tag"], b["label"], pa.array([_pack(x) for x in v], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array((v * v).sum(1))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "tag", "label", "vec", "cell", "far", "square"])

    return chosen.select("id", "tag", "label", "v").mapInArrow(place, "id long, tag long, label long, vec binary, cell int, far double, square long")


def _chunks(rows: DataFrame, by: Cells, blocks: int, near: np.ndarray, far: np.ndarray, home: bool, scale: float) -> DataFrame:
    """cell, block, ids, labels, vecs: rows packed for the anchors of a cell; home: those of its own cell, else the others within near to far of its pivot."""
    count, wide = len(by.pivots), by.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(batch["v"], scale, by.dim)
            d, ids, labels = by.distances(v, False), batch["id"].to_numpy(), batch["label"].to_numpy()
            own = d.argmin(1)
            out: list[tuple] = []
            for cell in range(count):
                mine = own == cell
                wanted = np.flatnonzero(mine if home else ~mine & (d[:, cell] >= near[cell] - wide) & (d[:, cell] <= far[cell] + wide))
                for k in range(0, len(wanted), CHUNK):
                    at = wanted[k : k + CHUNK]
                    block = (int(ids[at[0]]) * 0x9E3779B97F4A7C15 >> 20) % blocks
                    out.append((cell, block, ids[at].tobytes(), labels[at].tobytes(), _pack(v[at])))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["cell", "block", "ids", "labels", "vecs"])

    return rows.select("id", "label", "v").mapInArrow(run, "cell int, block int, ids binary, labels binary, vecs binary")


def local_best(queries: pa.Table, chunks: pa.Table, k: int, same: bool, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the first k rows of each query among the chunks, in any order; exact."""
    vecs = queries["vec"].to_pylist()
    where: dict[bytes, int] = {}
    of = np.array([where.setdefault(x, len(where)) for x in vecs])
    a = np.vstack([_unpack(x, dim) for x in where])
    aid, alabel, low, high = (queries[c].to_numpy() for c in ("id", "label", "low", "high"))
    bar = low.copy()  # what a row has to score
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in vecs]
    for ids, labels, packed in zip(*(chunks[c].to_pylist() for c in ("ids", "labels", "vecs"))):
        ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        s = scores(a, _unpack(packed, dim))
        for lo in range(0, len(of), 256):
            part = slice(lo, lo + 256)
            here = s[of[part]]
            hit = (here >= bar[part, None]) & (here <= high[part, None]) & ((labels == alabel[part, None]) == same) & (ids != aid[part, None])
            for q in np.flatnonzero(hit.any(1)):
                at, j = np.flatnonzero(hit[q]), lo + q
                i, x = np.concatenate((held[j][0], ids[at])), np.concatenate((held[j][1], here[q, at]))
                order = np.lexsort((i, -x))
                i, x = i[order], x[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (x[1:] != x[:-1])
                held[j] = i[new][:k], x[new][:k]
                if len(held[j][0]) == k:
                    bar[j] = max(bar[j], held[j][1][-1])
    size = [len(h[0]) for h in held]
    return np.repeat(np.arange(len(vecs)), size), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


_KEY = ["id", "tag", "p_id", "p_score"]
_FOUND = "id long, tag long, p_id long, p_score long, hit long, score long"


def _joined(queries: DataFrame, chunks: DataFrame, k: int, same: bool, dim: int, groups: dict[int, int], blocks: int) -> DataFrame:
    """_FOUND: up to k of each query and block. A cell's queries are dealt to groups, its chunks copied to each."""
    many = F.create_map(*[F.lit(x) for kv in (groups or {-1: 1}).items() for x in kv])
    left = queries.withColumn("group", F.pmod(F.xxhash64("id", "tag"), F.element_at(many, F.col("cell"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = F.coalesce(F.try_element_at(many, F.col("cell")), F.lit(0))
    right = chunks.filter(held > 0).withColumn("group", F.explode(F.sequence(F.lit(0), held - 1)))
    parts = int(min(max(sum(groups.values()) * blocks, 1), 20_000))
    keys = ("cell", "group", "block")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        names, kinds = _KEY + ["hit", "score"], [pa.int64()] * 6
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        at, hit, score = local_best(q, c, k, same, dim)
        return pa.table([*(q[n].take(pa.array(at)).combine_chunks() for n in _KEY), pa.array(hit), pa.array(score)], names)

    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query, with place from 1."""
    order = W.partitionBy(*_KEY).orderBy(F.col("score").desc(), "hit")
    return found.dropDuplicates([*_KEY, "hit", "score"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def best(queries: DataFrame, rows: DataFrame, by: Cells, k: int, same: bool, scale: float = SCALE, per_group: int = PER_GROUP, per_block: int = PER_BLOCK) -> DataFrame:
    """id, tag, p_id, p_score, hit, score, place: the first k rows of each query by falling score, ties by id.

    queries: an anchor's columns (anchors_of), p_id and p_score (which tell queries of one anchor apart), low and high (the scores that count, both ends); distinct.
    """
    queries = cut(queries)
    groups = {r.cell: -(-r["count"] // per_group) for r in queries.groupBy("cell").count().collect()}  # at most MAX_PIVOTS rows
    blocks, count = max(4, -(-by.n // per_block)), len(by.pivots)
    everywhere = np.zeros(count), np.full(count, np.inf)
    home = cut(_first(_joined(queries, _chunks(rows, by, blocks, *everywhere, True, scale), k, same, by.dim, groups, blocks), k))
    full = home.filter(F.col("place") == k).select(*[F.col(c).alias(f"f_{c}") for c in _KEY], F.col("score").alias("least"))
    asked = queries.join(full, F.expr(" AND ".join(f"{c} <=> f_{c}" for c in _KEY)), "left")
    asked = cut(asked.withColumn("low", F.greatest("low", F.coalesce("least", F.lit(_NONE)))).select(*queries.columns))
    span = lambda score: F.sqrt(F.greatest(F.col("square") + F.lit(float(by.longest)) - 2.0 * F.col(score).cast("double"), F.lit(0.0)))
    rings = asked.groupBy("cell").agg(F.min(span("high") - F.col("far")).alias("near"), F.max(span("low") + F.col("far")).alias("far"))
    near, far = np.full(count, np.inf), np.full(count, -np.inf)
    for r in rings.collect():  # at most MAX_PIVOTS rows
        near[r.cell], far[r.cell] = r.near, r.far
    rest = _joined(asked, _chunks(rows, by, blocks, near, far, False, scale), k, same, by.dim, groups, blocks)
    return _first(home.drop("place").unionByName(rest), k)


def mine(rows: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: id, label, v. A negative scores low to high hundredths of its positive."""
    asked = rows.filter(F.col("id") % every == 0).count()
    by = cells(rows, asked, scale)
    anchors = cut(anchors_of(rows, by, every, scale))
    none = F.lit(None).cast("long")
    near = cut(best(anchors.select("*", none.alias("p_id"), none.alias("p_score"), F.lit(_NONE).alias("low"), F.lit(_ALL).alias("high")), rows, by, positives, True, scale))
    pairs = near.filter("score >= 0").select("id", "tag", F.col("hit").alias("p_id"), F.col("score").alias("p_score"))
    window = [F.expr(f"({low} * p_score + 99) div 100").alias("low"), F.expr(f"{high} * p_score div 100").alias("high")]
    found = best(pairs.join(anchors, ["id", "tag"]).select(*anchors.columns, "p_id", "p_score", *window), rows, by, negatives, False, scale)
    return found.select(F.col("id").alias("anchor_id"), F.col("p_id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("hit").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(table(spark, sf_dir, "embeddings"))
    return mine(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), 100)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {
    "op12_hard_negatives": f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= {NEGATIVES}"""
}
