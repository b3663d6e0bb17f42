"""Files of fixed-size records as Python data sources: split by record, sought by time, written with a commit.

``point_stream`` reads and writes the big-endian point streams of sources.binary;
``day_records`` reads text files of equally long lines, sorted by their first column;
``grid_f32`` reads and writes one big-endian 32-bit grid a file, named by its hour;
``named_files`` writes a file for each row.
Register them with ``register(spark)``; files are opened through pyarrow's file systems,
so a path may be local, hdfs:// or s3://.

Reading. A large file becomes as many partitions as its size asks for, by place of
the records, without a look into it. Comparisons of the time column are pushed down
(they are exact here, Spark doesn't repeat them): in a sorted file each task finds the
ends of the range by binary search, reading 8 bytes or a line a step, and then reads
only what lies between.

Writing. A task writes to files of its own attempt under ``_temporary``; the commit on
the driver moves the files of the attempts that succeeded into place, then removes the
rest, and, when it overwrites, the old files. A task or job that fails leaves nothing
that a reader sees: names that begin with _ are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from geoflume.sources import binary as B

#: Bytes of a partition, and records that a task holds at a time.
SPLIT, HOLD = 64 << 20, 100_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_in(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """The visible files of a folder, or the file itself, by name."""
    info = fs.get_file_info(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f.path)), key=lambda f: f.path)


class Bytes:
    """A file that counts what is read of it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.read = fs.open_input_file(path), 0

    def at(self, offset: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, offset)

    def lines(self, until, most: int = 1 << 16) -> tuple[list[str], int]:
        """Leading lines up to the first of which until(line) holds, and where the next begins."""
        data, out, start = b"", [], 0
        while len(data) < most:
            more = self.at(len(data), 512)
            data += more
            while (end := data.find(b"\n", start)) >= 0:
                out.append(data[start:end].decode("ascii", "replace"))
                start = end + 1
                if until(out[-1]):
                    return out, start
            if not more:
                break
        raise ValueError(f"no end of header in the first {len(data)} bytes")


class PointRecords:
    """The points of a stream. Sorted by stamp if its second line says so."""

    def __init__(self, file: Bytes):
        head, at = file.lines(lambda x: x.startswith("# IEEE") or x.startswith("# char notes") and "and IEEE" in x)
        if not head[0].startswith("Point"):
            raise ValueError(f"not a point stream: {head[0][:40]}")
        dims = next(b for a, b in zip(head, head[1:]) if a.startswith("# Dim"))
        self.file, self.sorted = file, head[1].endswith(",sorted")
        self.variables, self.count = (int(x) for x in dims.split())
        self.notes, self.data = at, at + B.NOTE * self.count

    def column(self, k: int, i: int, j: int) -> np.ndarray:
        return np.frombuffer(self.file.at(self.data + 8 * (k * self.count + i), 8 * (j - i)), ">f8").astype("f8")

    def key(self, i: int) -> float:
        return float(self.column(0, i, i + 1)[0])

    def rows(self, i: int, j: int) -> pa.RecordBatch:
        raw = self.file.at(self.notes + B.NOTE * i, B.NOTE * (j - i))
        notes = [raw[k : k + B.NOTE].decode("ascii", "replace").strip(" \0") for k in range(0, len(raw), B.NOTE)]
        cols = [self.column(k, i, j) for k in range(self.variables)]
        if self.variables == len(B.COLUMNS) + 1:  # the longer form has a count before the value
            del cols[-2]
        return pa.RecordBatch.from_arrays([pa.array(notes, pa.string()), *map(pa.array, cols)], ["note", *B.COLUMNS])


class LineRecords:
    """Equally long lines of comma-separated text after one header line; the first column is the sorted key."""

    sorted = True

    def __init__(self, file: Bytes):
        [head], self.start = file.lines(lambda x: True)
        self.names = [x.strip() for x in head.split(",")]
        size = file.file.size() - self.start
        first = file.at(self.start, min(size, 1 << 16))
        self.file, self.width = file, first.index(b"\n") + 1 if first else 1
        if size % self.width:
            raise ValueError(f"{size} bytes aren't lines of {self.width}")
        self.count = size // self.width

    def key(self, i: int) -> str:
        return self.file.at(self.start + i * self.width, self.width).split(b",", 1)[0].strip().decode("ascii", "replace")

    def rows(self, i: int, j: int) -> pa.RecordBatch:
        lines = self.file.at(self.start + i * self.width, (j - i) * self.width).decode("ascii", "replace").split("\n")[:-1]
        cols = zip(*([x.strip() for x in line.split(",")] for line in lines))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], self.names)


def first_not_below(records, i: int, j: int, bound, strictly: bool) -> int:
    """The first place in i..j whose key is at least (strictly: above) the bound."""
    while i < j:
        mid = (i + j) // 2
        k = records.key(mid)
        if k < bound or strictly and k == bound:
            i = mid + 1
        else:
            j = mid
    return i


@dataclass(frozen=True)
class Range:
    """Bounds of the key: (value, whether it is left out itself)."""

    low: tuple | None = None
    high: tuple | None = None

    def narrowed(self, f: Filter, column: str) -> Range | None:
        """With one more comparison; None if it isn't one of the column."""
        if getattr(f, "attribute", None) != (column,) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.value is None:
            return None
        low, high = self.low, self.high
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            low = max((x for x in (low, (f.value, isinstance(f, GreaterThan))) if x), default=None)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            high = min((x for x in (high, (f.value, not isinstance(f, LessThan))) if x), default=None)
        return Range(low, high)

    def within(self, records, i: int, j: int) -> tuple[int, int]:
        if self.low:
            i = first_not_below(records, i, j, *self.low)
        if self.high:
            j = first_not_below(records, i, j, *self.high)
        return i, j

    def mask(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        if self.low:
            ok &= keys > self.low[0] if self.low[1] else keys >= self.low[0]
        if self.high:
            ok &= keys <= self.high[0] if self.high[1] else keys < self.high[0]
        return ok


@dataclass
class Part(InputPartition):
    path: str
    k: int
    parts: int


def read_part(records, part: int, parts: int, wanted: Range) -> Iterator[pa.RecordBatch]:
    """The wanted records of the k-th of so many equal parts of a file."""
    i, j = part * records.count // parts, (part + 1) * records.count // parts
    if records.sorted:
        i, j = wanted.within(records, i, j)
    for at in range(i, j, HOLD):
        batch = records.rows(at, min(at + HOLD, j))
        yield batch if records.sorted else batch.filter(pa.array(wanted.mask(batch.column(B.COLUMNS[0]).to_numpy())))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, kind, key: str, named: bool):
        self.path, self.split, self.kind, self.key, self.named, self.wanted = options["path"], int(options.get("splitbytes", SPLIT)), kind, key, named, Range()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f, self.key)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        sizes = [(f.path, max(1, -(-f.size // self.split))) for f in files_in(fs, path)]
        return [Part(p, k, n) for p, n in sizes for k in range(n)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for batch in read_part(self.kind(Bytes(fs, part.path)), part.k, part.parts, self.wanted):
            yield batch.add_column(0, "path", pa.array([part.path] * batch.num_rows, pa.string())) if self.named else batch


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Committed(DataSourceArrowWriter):
    """Per-attempt files that a commit moves into place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        fs, path = file_system(self.path)
        self.temp = f"{path}/_temporary/{self.job}"
        if not overwrite:
            fs.create_dir(path, recursive=True)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """(name, content) of each file; names differ between partitions."""
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _ = file_system(self.path)
        folder, names = f"{self.temp}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for name, content in self.files(batches):
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
            names.append(f"{folder}/{name}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = file_system(self.path)
        new = {f"{path}/{f.rpartition('/')[2]}": f for m in messages if m for f in m.files}
        if len(new) < sum(len(m.files) for m in messages if m):
            raise ValueError("two tasks wrote one file")
        old = [f.path for f in files_in(fs, path)] if self.overwrite else []
        fs.create_dir(path, recursive=True)
        for to, at in new.items():
            fs.move(at, to)
        for f in old:
            if f not in new:
                fs.delete_file(f)
        self.clear()
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, path = file_system(self.path)
        if fs.get_file_info(self.temp).type == pafs.FileType.Directory:
            fs.delete_dir(self.temp)
        if not fs.get_file_info(pafs.FileSelector(f"{path}/_temporary", allow_not_found=True)) and fs.get_file_info(f"{path}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary")


class PointWriter(Committed):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.variable, self.units, self.start, self.piece = options.get("variable", "value"), options.get("units", "-"), options.get("start", "-"), int(options.get("piece", B.PIECE))

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= self.piece:
                t = pa.Table.from_batches(held)
                yield self.stream(t.slice(0, self.piece))
                held = t.slice(self.piece).to_batches()
        if any(x.num_rows for x in held):
            yield self.stream(pa.Table.from_batches(held))

    def stream(self, t: pa.Table) -> tuple[str, bytes]:
        rows = {c: t[c].to_numpy().astype("f8") for c in B.COLUMNS}
        origin = "geoflume" + ",sorted" * bool((np.diff(rows["stamp"]) >= 0).all())
        return f"{self.job}-{uuid.uuid4().hex}.xdr", B.encode(rows, [n or "" for n in t["note"].to_pylist()], self.variable, self.units, self.start, origin)


class PointStreams(DataSource):
    """Options: path; splitbytes (reading); variable, units, start, piece (writing)."""

    @classmethod
    def name(cls) -> str:
        return "point_stream"

    def schema(self) -> str:
        return B.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options, PointRecords, "stamp", True)

    def writer(self, schema, overwrite: bool) -> Committed:
        return PointWriter(self.options, overwrite)


class DayRecords(DataSource):
    """Options: path; splitbytes. The schema (of strings) is that of the first file's header."""

    @classmethod
    def name(cls) -> str:
        return "day_records"

    def records(self) -> LineRecords:
        fs, path = file_system(self.options["path"])
        return LineRecords(Bytes(fs, files_in(fs, path)[0].path))

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in self.records().names)

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options, LineRecords, schema[0].name, False)


class GridWriter(Committed):
    """Rows have to come sorted by hour, each hour's in one partition."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.shape, self.missing = (int(options["rows"]), int(options["cols"])), float(options.get("missing", -9999))

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        hour, grid = None, np.full(self.shape, self.missing, ">f4")
        for b in batches:
            hours, row, col, value = (b.column(c).to_numpy() for c in ("hour", "row", "col", "value"))
            cuts = [0, *(np.flatnonzero(np.diff(hours)) + 1), len(hours)] if len(hours) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if hours[i] != hour:
                    if hour is not None:
                        yield f"{hour}.bin", grid.tobytes()
                    hour = hours[i]
                    grid.fill(self.missing)
                grid[self.shape[0] - 1 - row[i:j], col[i:j]] = value[i:j]
        if hour is not None:
            yield f"{hour}.bin", grid.tobytes()


class NamedWriter(Committed):
    """A file for each row of (name, content); names are distinct."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            yield from zip(b.column("name").to_pylist(), b.column("content").to_pylist())


class NamedFiles(DataSource):
    """Options: path. Writes only; binaryFile reads."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> Committed:
        return NamedWriter(self.options, overwrite)


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shape, self.missing = options["path"], (int(options["rows"]), int(options["cols"])), float(options.get("missing", -9999))

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        return [Part(f.path, 0, 1) for f in files_in(fs, path)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, cols = self.shape
        file, hour = fs.open_input_file(part.path), int(part.path.rpartition("/")[2].split(".")[0])
        for top in range(0, rows, max(1, HOLD // cols)):
            n = min(max(1, HOLD // cols), rows - top)
            g = np.frombuffer(file.read_at(4 * n * cols, 4 * top * cols), ">f4").astype("f4").reshape(n, cols)
            r, c = np.nonzero(g != np.float32(self.missing))
            cols_ = [pa.array(np.full(len(r), hour)), pa.array((rows - 1 - top - r).astype("i4")), pa.array(c.astype("i4")), pa.array(g[r, c].astype("f8"))]
            yield pa.RecordBatch.from_arrays(cols_, ["hour", "row", "col", "value"])


class GridFiles(DataSource):
    """Options: path, rows, cols, missing. North row first; cells without a value aren't given out."""

    @classmethod
    def name(cls) -> str:
        return "grid_f32"

    def schema(self) -> str:
        return "hour long, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options)

    def writer(self, schema, overwrite: bool) -> Committed:
        return GridWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """The session with the sources and pushed filters."""
    for source in (PointStreams, DayRecords, GridFiles, NamedFiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_points(spark: SparkSession, path: str, low: float | None = None, high: float | None = None, **options) -> DataFrame:
    """The points of low <= stamp < high. Each call is a relation of its own: Spark keeps one pushed range a relation, so don't filter one by two ranges in a query."""
    rows = register(spark).read.format("point_stream").options(**options).load(path)
    rows = rows if low is None else rows.filter(F.col("stamp") >= F.lit(float(low)))
    return rows if high is None else rows.filter(F.col("stamp") < F.lit(float(high)))


def read_days(spark: SparkSession, path: str, low: str | None = None, high: str | None = None, **options) -> DataFrame:
    """The lines of low <= first column < high of day_records files, as strings; each call is a relation of its own, as in read_points."""
    rows = register(spark).read.format("day_records").options(**options).load(path)
    key = F.col(f"`{rows.columns[0]}`")
    rows = rows if low is None else rows.filter(key >= low)
    return rows if high is None else rows.filter(key < high)


def write_points(points: DataFrame, path: str, variable: str, units: str, start: str, mode: str = "append", partitions: int | None = None) -> None:
    """Point streams, each sorted by stamp and of stamps that no other has but its neighbours."""
    rows = points.select(F.lit("").alias("path"), F.coalesce("note", F.lit("")).alias("note"), *[F.col(c).cast("double").alias(c) for c in B.COLUMNS])
    n = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "stamp", "id").sortWithinPartitions("stamp", "id")
    rows.write.format("point_stream").options(variable=variable, units=units, start=start).mode(mode).save(path)


def write_grids(cells: DataFrame, path: str, rows: int, cols: int, mode: str = "append") -> None:
    """A file for each hour of cells (hour, row, col, value)."""
    kept = cells.select(F.col("hour").cast("long").alias("hour"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    kept.repartition("hour").sortWithinPartitions("hour").write.format("grid_f32").options(rows=rows, cols=cols).mode(mode).save(path)
