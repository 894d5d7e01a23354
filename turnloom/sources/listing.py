"""Folders of very many files, listed and read by tasks, so that the driver holds neither their names nor a task for some few of each.

Spark's file sources keep the status of every file in the driver, and plan a task for each few small ones. Here a table holds
the names: listed() makes it, a level of folders at a time, and scan_listed() gives the lines of its files as
lines.scan() does. Paths are those that pyarrow.fs reads; names stay as they are stored, where scan() has odd characters as %XX.

Defined results, as of Spark's reader: hidden names (a dot or an underscore before) are left out, empty files give nothing, lines end
at a line feed, a carriage return or both, a byte-order mark is no part of a line, bytes are not changed, .zst archives are unpacked, and of a
file that can't be read on, the lines so far count. A folder's own entries are listed by one task and a file is read by
one; a task holds the names in one folder, or a line and a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import written
from turnloom.sources.lines import located

_STEP = 1 << 20
#: Opening a file counts as so many bytes where files are dealt into tasks, and a task gets so many at least.
_OPEN, _SHARE = 64 << 10, 64 << 20
_MARK = b"\xef\xbb\xbf"
_HIDDEN = re.compile(r"\.|_(?!common_metadata|metadata)[^=]*$|.*\._COPYING_$", re.DOTALL)
_ENTRIES = pa.schema([("file", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])
_ROWS = pa.schema([("_file", pa.string()), ("_modified", pa.int64()), ("pos", pa.int64()), ("value", pa.binary())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and what stands before the store's own names in the path's."""
    store, root = pafs.FileSystem.from_uri(path)
    return store, path.removesuffix(root) if path.endswith(root) else ""


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _entries(path: str, names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, before = opened(path)
        rows = []
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                # a folder below the path may be gone by now, the path itself not
                for x in store.get_file_info(pafs.FileSelector(folder.removeprefix(before), allow_not_found=folder != path)):
                    if _HIDDEN.match(x.base_name) or not (x.type == pafs.FileType.Directory or x.is_file and x.size and fnmatchcase(x.base_name, names)):
                        continue
                    rows.append((before + x.path, x.size if x.is_file else None, (x.mtime_ns or 0) // 1000, not x.is_file))
                    if len(rows) >= 10_000:
                        yield _batch(rows, _ENTRIES)
                        rows = []
        if rows:
            yield _batch(rows, _ENTRIES)

    return run


def listed(spark: SparkSession, path: str, names: str) -> DataFrame:
    """file, length and modified (microseconds) of the files below a path whose names match a pattern (*, ?, [...])."""
    path, tasks = path.rstrip("/"), 4 * spark.sparkContext.defaultParallelism
    schema = "file string, length long, modified long, folder boolean"
    level, found = spark.range(1).select(F.lit(path).alias("file")), None
    while found is None or not level.isEmpty():
        below = written(level.repartition(tasks).mapInArrow(_entries(path, names), schema), "listing")
        level, found = below.where("folder").select("file"), below if found is None else found.unionByName(below)
    return found.where("not folder").drop("folder")


def file_lines(f: pa.NativeFile) -> Iterator[bytes]:
    """The lines of an open file."""
    held, returned, start = [], False, True
    while data := f.read(_STEP):
        # a line feed behind the carriage return that ended the step before ends no further line
        data = data[1:] if returned and data.startswith(b"\n") else data
        data, start = data.removeprefix(_MARK) if start else data, False
        returned = data.endswith(b"\r")
        done = data.splitlines()
        rest = done.pop() if data and not data.endswith((b"\n", b"\r")) else b""
        for line in done:
            yield b"".join([*held, line])
            held = []
        if rest:
            held.append(rest)
    if held:
        yield b"".join(held)


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, before = opened(path)
        rows, held = [], 0
        for part in batches:
            for file, modified in zip(part.column("file").to_pylist(), part.column("modified").to_pylist(), strict=True):
                try:
                    with store.open_input_file(file.removeprefix(before)) as f:
                        for pos, line in enumerate(file_lines(pa.CompressedInputStream(f, "zstd") if file.endswith(".zst") else f)):
                            rows.append((file, modified, pos, line))
                            held += len(line) + len(file)
                            if held > _STEP:
                                yield _batch(rows, _ROWS)
                                rows, held = [], 0
                except FileNotFoundError:
                    raise
                except (OSError, pa.ArrowException):
                    continue
        if rows:
            yield _batch(rows, _ROWS)

    return run


def dealt_files(files: DataFrame) -> DataFrame:
    """The files of a listing in as many pieces as their bytes ask for, and a few for each core at least if there are so many files."""
    size, n = files.agg(F.sum(F.col("length") + _OPEN), F.count("*")).first()
    return files.repartition(max(1, -(-(size or 0) // _SHARE), min(n, 4 * files.sparkSession.sparkContext.defaultParallelism)))


def scan_listed(files: DataFrame, path: str, layout: str, home: str | None = None) -> DataFrame:
    """The lines of files that listed() found below a path, with the columns of lines.scan()."""
    rows = dealt_files(files).select("file", "modified").mapInArrow(_read(path.rstrip("/")), "_file string, _modified long, pos long, value binary")
    rows = rows.select(*located(layout, home, F.col("_file"), F.timestamp_micros("_modified")), "pos", F.col("value").cast("string").alias("value"))
    return rows.select("agent", "home", "session_id", "file", "value", "file_time", "pos")
