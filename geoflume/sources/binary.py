"""Binary sources and sinks: big-endian point streams and grid files.

A point stream is ASCII header lines, then ``notes[points][80]`` and
``data[variables][points]`` of big-endian 64-bit reals. Files are read one a task
with ``binaryFile`` and decoded in Arrow batches; the writer sorts within its
partitions and writes a stream for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = 80
#: Points of a stream, some 8 MB, and of a decoded batch.
PIECE, ROWS = 1 << 16, 1 << 13
COLUMNS = ("stamp", "lon", "lat", "elevation", "id", "value")
SCHEMA = "path string, note string, stamp double, lon double, lat double, elevation double, id double, value double"


def encode(rows: dict[str, np.ndarray], notes: list[str], variable: str, units: str, start: str, origin: str = "geoflume") -> bytes:
    """One point stream."""
    head = ["Point 1.0", origin, start, "# Dimensions: variables points", f"{len(COLUMNS)} {len(notes)}", "# Variable names:", f"timestamp longitude latitude elevation id {variable}", "# Variable units:", f"yyyymmddhhmmss deg deg m - {units}", "# char notes[points][80] and IEEE-754 64-bit reals data[variables][points]:"]
    body = b"".join(n.encode("ascii", "replace")[: NOTE - 1].ljust(NOTE) for n in notes)
    return ("\n".join(head) + "\n").encode() + body + b"".join(np.asarray(rows[c], ">f8").tobytes() for c in COLUMNS)


def _opened(data: bytes | memoryview) -> tuple[int, int, int]:
    """Variables, points and the place of the notes of a point stream."""
    at = 0
    lines = []
    while not lines or not lines[-1].startswith("# char"):
        line = bytes(data[at : at + 4096]).partition(b"\n")
        if not line[1]:
            raise ValueError("a point stream's header doesn't end")
        lines.append(line[0].decode("ascii", "replace"))
        at += len(line[0]) + 1
    if not lines[0].startswith("Point"):
        raise ValueError(f"not a point stream: {lines[0][:40]}")
    variables, points = map(int, re.findall(r"\d+", next(x for a, x in zip(lines, lines[1:]) if a.startswith("# Dim"))))
    return variables, points, at


def decode(data: bytes | memoryview) -> tuple[list[str], np.ndarray]:
    """Notes and the array [variables][points] of a point stream."""
    _, points, _ = _opened(data)
    return next(decoded(data, max(points, 1)))


def decoded(data: bytes | memoryview, rows: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Notes and arrays [variables][rows] of a point stream, so many points at a time; nothing is copied but these."""
    variables, points, at = _opened(data)
    values = np.frombuffer(data, ">f8", variables * points, at + points * NOTE).reshape(variables, points)
    for k in range(0, max(points, 1), rows):
        n = min(points, k + rows)
        notes = [bytes(data[at + i * NOTE : at + (i + 1) * NOTE]).decode("ascii", "replace").strip() for i in range(k, n)]
        yield notes, values[:, k:n].astype("f8")


def points_of(streams: DataFrame) -> DataFrame:
    """The points of streams (path, content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                for notes, data in decoded(memoryview(content.as_buffer()), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(notes), pa.string()), pa.array(notes, pa.string()), *[pa.array(v) for v in data]], names=["path", "note", *COLUMNS])

    return streams.select("path", "content").mapInArrow(rows, SCHEMA)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return points_of(spark.read.format("binaryFile").load(path))


def point_streams(points: DataFrame, variable: str, units: str, start: str) -> DataFrame:
    """part, content: streams of at most PIECE points of each partition (note and the columns of a stream), for a binary sink. part is the first point's id."""

    def stream(t: pa.Table) -> pa.RecordBatch:
        content = encode({c: t[c].to_numpy() for c in COLUMNS}, t["note"].to_pylist(), variable, units, start)
        return pa.RecordBatch.from_arrays([pa.array([int(t["id"][0].as_py())], pa.int64()), pa.array([content], pa.binary())], names=["part", "content"])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while len(held) >= PIECE:
                yield stream(held.slice(0, PIECE))
                held = held.slice(PIECE)
        if held is not None and len(held):
            yield stream(held)

    rows = points.select(F.coalesce("note", F.lit("")).alias("note"), *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    return rows.sortWithinPartitions("stamp", "id").mapInArrow(streams, "part long, content binary")


def grid_file(cells: DataFrame, rows: int, cols: int, missing: float = -9999.0) -> DataFrame:
    """hour, content: the 32-bit big-endian grid of each hour (row, col, value), north row first, absent cells missing."""

    def grids(key: tuple, t: pa.Table) -> pa.Table:
        g = np.full((rows, cols), missing, ">f4")
        g[rows - 1 - t["row"].to_numpy(), t["col"].to_numpy()] = t["value"].to_numpy()
        return pa.table({"hour": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([g.tobytes()], pa.binary())})

    return cells.groupBy("hour").applyInArrow(grids, "hour long, content binary")
