"""What the corpus operators share: keys, checkpoints and hashed words.

Every operator reads its columns by name and drops the rest, so other columns
of the input, whatever they are called, have no effect on it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators; it sorts before all others.
NULL_ID = -(2**63)
#: Bytes of text that the numpy helpers take at a time.
CHUNK = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """id, tag, text without nulls. tag tells rows of one doc_id with different texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(id_of(F.col("doc_id")).alias("id"), tag_of(text).alias("tag"), text.alias("text"))


def tag_of(text: Column) -> Column:
    """64 bits of a hash of the text: rows that share a doc_id, as all with a null one do, are told apart by these."""
    return F.xxhash64(text)


def id_of(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    return F.when(col != F.lit(NULL_ID), col)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a folder of its own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="geoflume-"))
    return sc.getCheckpointDir()


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that are taken (Spark compares names without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep_rows(documents: DataFrame, text: Column, keep: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows whose text, worked out by the column given, passes keep()'s mask; one scan, whatever the columns are called."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    [extra] = free(documents.columns, "text")
    rows = documents.select("*", text.alias(extra)).toDF(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for b in batches:
            yield b.filter(pa.array(passes(b["text"])))

    return rows.mapInArrow(run, rows.schema).drop("text").toDF(*documents.columns)


#: The white space of the contracts: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def chunks(texts: pa.Array, size: int = CHUNK):
    """(first row, bytes, offsets) of consecutive rows of a text column, about size bytes at a time; no row is split."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in."""
    full = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate(([False], full[:-1])) & ~first[: len(data)]
    after = np.concatenate((full[1:], [False])) & ~first[1:]
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice; equal slices have equal hashes in every process."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INV, n + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each n consecutive hashes."""
    if len(h) < n:
        return h[:0]
    last = len(h) - n + 1
    out = np.zeros(last, np.uint64)
    for j in range(n):
        out = out * np.uint64(base) + h[j : j + last]
    return mix(out)
