"""Line dedup: lines found in many documents stay only in the document with the largest doc_id.

DataFrame functions only. Lines are exploded as (document, position, hash of the
normalised line); the distinct documents of each hash are counted; positions of
lines over the threshold come back to their documents, which are put together
again without them. The texts themselves are shuffled once. The repeated lines'
hashes are checkpointed before they are joined, so they have an exchange of their
own and the adaptive plan sees their size: it broadcasts them while they are under
its threshold and splits the other side of a frequent line beyond.

Defined cases: a null or empty text is one empty line; rows without doc_id count
as one document, before all others; rows that share a doc_id count as one
document for the threshold and are put together each on its own; other columns
have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import col, cut, free, id_back, id_of, keyed, table, tag_of

MIN_CHARS, MIN_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _joined(lines: Column, keep: Column) -> Column:
    """The lines at the places kept. The array of lines is bound once: named inside the inner lambda, the text would be split anew for every line."""
    parts = F.transform(F.array(lines), lambda every: F.transform(keep, lambda i: F.get(every, i)))
    return F.array_join(F.element_at(parts, 1), "\n")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, tag, at: positions of the lines that go (docs as from keyed())."""
    keys = docs.select("id", "tag", F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"))
    keys = keys.filter(F.length("key") >= min_chars).select("id", "tag", "pos", F.unhex(F.md5("key")).alias("h"))
    held = keys.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("docs"), F.max("id").alias("stays"))
    gone = keys.join(cut(held.filter(F.col("docs") >= min_docs).select("h", "stays")), "h").filter("id <> stays")
    return gone.groupBy("id", "tag").agg(F.collect_set("pos").alias("at"))


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    lines = _lines(F.col("text"))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    out = docs.join(dropped_lines(docs, min_chars, min_docs), ["id", "tag"], "left")
    out = out.withColumn("keep", F.when(F.col("at").isNotNull(), F.array_except(every, F.col("at"))))
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(_joined(lines, F.col("keep")))
    n = F.size(lines)
    return out.select("id", "tag", n.cast("long").alias("n_lines"), F.when(F.col("keep").isNull(), 0).otherwise(n - F.size("keep")).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept for each row."""
    out = _with_kept(keyed(documents), min_chars, min_docs)
    return out.select(id_back(F.col("id")).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "kept")


def without_repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's rows and columns, with the repeated lines gone from text. A null text stays null."""
    i, t, id, tag, at = free(documents.columns, "i", "t", "id", "tag", "at")
    gone = dropped_lines(keyed(documents), min_chars, min_docs).toDF(id, tag, at)
    rows = documents.select("*", id_of(F.col("doc_id")).alias(i), tag_of(F.coalesce(F.col("text"), F.lit(""))).alias(t))
    rows = rows.join(gone, (F.col(i) == F.col(id)) & (F.col(t) == F.col(tag)), "left")
    lines = _lines(F.col("text"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = F.when(F.col(at).isNull(), F.col("text")).otherwise(_joined(lines, keep))
    out = rows.withColumn("text", kept)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in documents.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept")


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, {_TRIM}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM docs) d,
       LATERAL (SELECT unnest(d.l) AS line, unnest(range(len(d.l))) AS pos) t
),
held AS (
  SELECT key, max(doc_id) AS stays FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (h.key IS NOT NULL AND l.doc_id <> h.stays) AS gone
  FROM lines l LEFT JOIN held h ON l.key = h.key
)"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {
    "op2_line_dedup": f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
