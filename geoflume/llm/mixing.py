"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Targets share the corpus's words by source weight; a target stops at ``most``
times its source's size and the excess is shared again by weight among the
others, until none is above. A source is taken in whole epochs first; the rest
of its target comes from a weighted sample: every document gets the key
-ln(u) / w, with u from a hash of its doc_id and text and w its quality, and
documents are taken by rising key until the rest is met. The document that
crosses the target is taken in part, so a source meets its target to the word.

The order within a source is not sorted as a whole: keys are dealt into bins, the
bins' sizes are summed up, and only the rows of the bin in which the source's rest
ends are ordered, to find the crossing document. All others are taken or left by
comparing them with it, so no text and no large source is shuffled for it. The keys
and sizes are computed once and checkpointed. Targets are found in one task, whose
rows are the sources; bins are dealt so that one holds about ``PER_BIN`` rows.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a
null source is a source of its own, last in order; a null doc_id stays null;
equal keys are ordered by doc_id and text; repeated rows (same doc_id, source and
text) are alike and share what is taken of them evenly, rounded down, so where one
of n copies crosses the target up to n - 1 words less are taken; sources of size 0
have target 0; other columns have no effect; an empty table gives no rows. mixed()
keeps the caller's columns of its own names as <name>_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.llm._common import col, cut, free, table

WEIGHTS, MOST, PER_BIN, SEED = (1.0, 2.0, 3.0), 3, 20_000, "mix-1"
_SPACE = " \t\n\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """The text with one space between words and none at the ends."""
    return F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE)), r"[\x20\x09-\x0D]+", " ")


def words(text: Column) -> Column:
    spaced = _spaced(text)
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def quality(text: Column) -> Column:
    """Share of letters among the characters that aren't spaces, from 0.05 to 1."""
    solid = F.length(F.replace(_spaced(text), F.lit(" "), F.lit("")))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, solid), F.lit(0.05)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row a source.

    Sources are ordered by their cap over their weight, and the first n of them
    are at their caps. What is left, over the weights that are left, rises with
    n up to the right n and falls beyond it, so its maximum is the level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rate = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    caps = sizes.withColumn("w", rate).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = caps.withColumn("level", left / F.sum("w").over(after))
    level = level.withColumn("level", F.max("level").over(everyone))
    return level.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def _keyed(documents: DataFrame, seed: str, weight: Column | None) -> list[Column]:
    """doc_id, source, tag, size and key of a row; a weight under 1e-12, or a null one, counts as that."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    w = quality(F.col("text")) if weight is None else F.greatest(weight, F.lit(1e-12))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64(text).alias("tag"), words(F.col("text")).alias("size"), (-F.log(u) / w).alias("key")]


#: Rows of a plan, one a source, up to which it is broadcast.
FEW = 100_000


def _joined(rows: DataFrame, plan: DataFrame, on: str) -> DataFrame:
    """The rows beside their source's plan, which is broadcast if its counted rows are few."""
    few = plan.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(plan) if few else plan, F.expr(on))


def _plan(rows: DataFrame, weights: tuple[float, ...], most: int, per_bin: int) -> DataFrame:
    """One row a source: p_source, source_size, target, epochs, the crossing document (c_key, c_id, c_tag) and what each copy of it gives (c_taken)."""
    bins = int(min(max(rows.count() // per_bin, 64), 1 << 22))
    rows = rows.withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * bins).cast("int"))
    binned = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    goal = targets(binned.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
    due = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(due, F.col("source_size"))), F.lit(0))
    goal = cut(goal.select(F.col("source").alias("p_source"), "source_size", "target", epochs.alias("epochs"), (due - epochs * F.col("source_size")).alias("rest")))
    start = F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = _joined(binned.withColumn("start", start), goal.select("p_source", "rest"), "source <=> p_source").filter("start < rest and start + bin_size >= rest")
    at = cut(at.select("p_source", F.col("bin").alias("p_bin"), (F.col("rest") - F.col("start")).alias("left")))
    last = _joined(rows, at, "source <=> p_source and bin = p_bin").groupBy("p_source", "left", "key", "doc_id", "tag", "size").agg(F.count("*").alias("n"))
    order = W.partitionBy("p_source").orderBy("key", F.col("doc_id").asc_nulls_first(), "tag").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))).filter("before < left and before + n * size >= left")
    cross = last.select(F.col("p_source").alias("c_source"), F.col("key").alias("c_key"), F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag"), F.floor((F.col("left") - F.col("before")) / F.col("n")).alias("c_taken"))
    return cut(goal.join(cross, F.expr("p_source <=> c_source"), "left").drop("c_source", "rest"))


def _taken() -> Column:
    """What is taken of a row beside its source's plan."""

    def place(key: str, doc_id: str, tag: str) -> Column:
        return F.struct(F.col(key).alias("key"), F.col(doc_id).isNotNull().alias("known"), F.coalesce(F.col(doc_id), F.lit(0)).alias("id"), F.col(tag).alias("tag"))

    mine, cross = place("key", "doc_id", "tag"), place("c_key", "c_id", "c_tag")
    part = F.when(F.col("c_key").isNull(), 0).when(mine < cross, F.col("size")).when(mine == cross, F.col("c_taken")).otherwise(0)
    return (F.col("epochs") * F.col("size") + F.least("size", part)).cast("long")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, per_bin: int = PER_BIN, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """doc_id, tag, size, source_size, target, taken; weight: a column for the quality, else quality() of the text."""
    rows = cut(documents.select(*_keyed(documents, seed, weight)))
    rows = _joined(rows, _plan(rows, weights, most, per_bin), "source <=> p_source")
    return rows.select("doc_id", "tag", "size", "source_size", "target", _taken().alias("taken"))


ADDED = ("size", "source_size", "target", "taken")


def mixed(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, per_bin: int = PER_BIN, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """The documents of which words are taken, with size, source_size, target and taken beside their own columns."""
    keys = _keyed(documents, seed, weight)
    plan = _plan(cut(documents.select(*keys)), weights, most, per_bin)
    rows = documents.select(F.struct(*[col(c) for c in documents.columns]).alias("document"), *keys)
    rows = _joined(rows, plan, "source <=> p_source").withColumn("taken", _taken()).filter("taken > 0")
    own: list[str] = []
    for c in documents.columns:
        own += free([*documents.columns, *own], f"{c}_input") if c.lower() in ADDED else [c]
    return rows.select(*[F.col("document").getField(c).alias(a) for c, a in zip(documents.columns, own)], *ADDED)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("tag")


ORACLE_MIX = f"""
base AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM docs
),
sized AS (
  SELECT doc_id, source, t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g') AS solid,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || t), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM base
),
keys AS (
  SELECT doc_id, source, size,
    -ln(u) / greatest(0.05::DOUBLE, coalesce(length(regexp_replace(solid, '[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+', '', 'g'))::DOUBLE / nullif(length(solid), 0), 0.05::DOUBLE)) AS key
  FROM sized
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keys GROUP BY source),
caps AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM sizes
),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
),
goal AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels
),
due AS (
  SELECT source, source_size, target, round(target)::BIGINT AS d, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goal
),
mixed AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, (g.epochs * k.size
    + greatest(0, least(k.size, g.d - g.epochs * g.source_size
      - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
  FROM keys k JOIN due g ON k.source IS NOT DISTINCT FROM g.source
)"""
QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {"op10_mixing": f"WITH docs AS (SELECT * FROM documents), {ORACLE_MIX}\nSELECT doc_id, size, source_size, target, taken FROM mixed"}
