"""Snapshots of sensors as a stream whose cursor is the newest file's stamp.

A poller leaves files ``<name>_yyyymmddhhmmss.json`` (``data_time_stamp``, ``fields``,
``data``) in a folder. The stream's offset is the stamp of the newest file; a batch holds
the files past the last offset up to that. A file is read up to three times; one that is
an error message, isn't whole or has too few rows goes to ``<name>.bad`` beside it and
counts as read. Offsets are kept by Spark's checkpoint, so a query that stops and starts
again gives each file's rows once to a sink that takes a batch once. As in the poller, a
file that arrives with a stamp at or under the cursor is not seen again.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from geoflume.sources.record_files import file_system, files_in

_STAMP = re.compile(r"_(\d{14})\.json$")
TRIES, LEAST_ROWS, WAIT = 3, 1, 0.5
COLUMNS = ("stamp", "taken", "reading")


@dataclass
class Files(InputPartition):
    paths: list[str]


def whole(text: str, least: int) -> dict:
    """The snapshot, or a ValueError that says what is wrong with it."""
    found = json.loads(text)
    if not isinstance(found, dict) or "error" in found:
        raise ValueError("an error message")
    fields, data = found.get("fields"), found.get("data")
    if not isinstance(fields, list) or not isinstance(data, list) or len(data) < least or any(not isinstance(r, list) or len(r) != len(fields) for r in data):
        raise ValueError("fields and data don't fit, or too few rows")
    return found


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.tries, self.least, self.wait = options["path"], int(options.get("tries", TRIES)), int(options.get("leastrows", LEAST_ROWS)), float(options.get("wait", WAIT))
        self.per_task = int(options.get("filespertask", 8))

    def initialOffset(self) -> dict:
        return {"stamp": ""}

    def _stamped(self) -> list[tuple[str, str]]:
        fs, path = file_system(self.path)
        return sorted((m[1], f.path) for f in files_in(fs, path) if (m := _STAMP.search(f.path)))

    def latestOffset(self) -> dict:
        found = self._stamped()
        self.newest = max(getattr(self, "newest", ""), found[-1][0] if found else "")  # a file in quarantine doesn't turn it back
        return {"stamp": self.newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [p for s, p in self._stamped() if start["stamp"] < s <= end["stamp"]]
        return [Files(new[k : k + self.per_task]) for k in range(0, len(new), self.per_task)]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in part.paths:
            found = self._tried(fs, path)
            if found is None:
                continue
            fields, taken = [str(f) for f in found["fields"]], int(found.get("data_time_stamp") or 0) or None
            rows = [[(k, None if v is None else str(v)) for k, v in zip(fields, r)] for r in found["data"]]
            kinds = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([_STAMP.search(path)[1]] * len(rows)), pa.array([taken] * len(rows), pa.int64()), pa.array(rows, kinds)], list(COLUMNS))

    def _tried(self, fs: pafs.FileSystem, path: str) -> dict | None:
        for n in range(self.tries):
            try:
                with fs.open_input_file(path) as f:
                    return whole(f.read().decode("utf-8", "replace"), self.least)
            except FileNotFoundError:
                if fs.get_file_info(f"{path}.bad").type == pafs.FileType.File:
                    return None  # an earlier attempt of this task put it there
                raise
            except ValueError:
                time.sleep(self.wait * (n + 1 < self.tries))
        fs.move(path, f"{path}.bad")
        return None

    def commit(self, end: dict) -> None:
        pass


class SensorCursor(DataSource):
    """Options: path; tries, leastrows, wait (seconds between tries), filespertask."""

    @classmethod
    def name(cls) -> str:
        return "sensor_cursor"

    def schema(self) -> str:
        return "stamp string, taken long, reading map<string,string>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CursorReader(self.options)


def snapshots(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """stamp (of the file), taken (seconds, from within it) and reading (field to text) of each sensor and file, as a stream."""
    spark.dataSource.register(SensorCursor)
    return spark.readStream.format("sensor_cursor").options(**options).load(path)
