"""Whether a scan delivered each file whole: an integrity pass beside the lines of sources.lines.scan().

scan() skips what can't be read, so a file that is cut or fails half-way leaves fewer lines and no error. partial_files()
compares what came with what is stored and names the state of every file:

- unreadable: it is not empty, but no line of it came;
- cut archive: a .zst whose last frame has no end (frames are walked by their block headers, nothing is unpacked);
- cut short: fewer bytes came than are stored;
- cut line: the last line is no JSON object, so an entry was cut in the middle;
- unchecked: an archive too large for one row, of which lines came;
- whole: none of these.

Only archives are read a second time, for their headers; of other files the names and sizes are enough. Empty files have no row: Spark does not list them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.lines import LAYOUTS, is_blank, is_object, located
from turnloom.sources.listing import dealt_files, opened

# The archive format's magic numbers and header sizes.
_FRAME, _SKIPPED = 0xFD2FB528, 0x184D2A50
_DICTIONARY_BYTES, _SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
_MOST = (1 << 31) - 1 - 1024


def archive_is_whole(data: bytes | memoryview) -> bool:
    """Whether an archive is some frames, each with its end, and nothing behind them."""
    at, size = 0, len(data)
    if not size:
        return False
    while at < size:
        if at + 8 > size:
            return False
        magic, following = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == _SKIPPED:
            at += 8 + following
            continue
        if magic != _FRAME:
            return False
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content = _SIZE_BYTES[flags >> 6] or single
        at += 5 + (1 - single) + _DICTIONARY_BYTES[flags & 3] + content
        last = False
        while not last:
            if at + 3 > size:
                return False
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind = bool(head & 1), head >> 1 & 3
            at += 3 + (1 if kind == 1 else head >> 3)
        at += 4 * checksum
    return at == size


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [None if not x.is_valid else archive_is_whole(memoryview(x.as_buffer())) for x in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("_archive"), pa.array(whole, pa.bool_())], ["_archive", "_whole"])


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("ignoreCorruptFiles", "true").load(path)


def _walked_at(path: str):
    """_walked() of files by their names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, before = opened(path)

        def whole(file: str) -> bool | None:
            try:
                with store.open_input_file(file.removeprefix(before)) as f:
                    return archive_is_whole(f.read())
            except OSError:
                return None

        for batch in batches:
            names = batch.column("_archive")
            yield pa.RecordBatch.from_arrays([names, pa.array([whole(x) for x in names.to_pylist()], pa.bool_())], ["_archive", "_whole"])

    return run


def _state() -> Column:
    archived = F.col("file").endswith(".zst")
    return (
        F.when((F.col("length") > 0) & F.col("n_lines").isNull(), "unreadable")
        .when(archived & (F.col("length") > _MOST), "unchecked")
        .when(archived & ~F.coalesce("_whole", F.lit(False)), "cut archive")
        # Line ends are one byte, or two with a carriage return; the last may be missing.
        .when(~archived & (F.col("_bytes") + 2 * F.col("n_lines") < F.col("length")), "cut short")
        .when(~F.coalesce(F.col("_sound"), F.lit(True)), "cut line")
        .otherwise("whole")
    )


def partial_files(spark: SparkSession, path: str, layout: str, lines: DataFrame, home: str | None = None, names: str | None = None, listing: DataFrame | None = None) -> DataFrame:
    """agent, home, session_id, file, length, n_lines and state of every file of a layout below a path; lines as scan() gave them.

    With a listing of the path, as of listing.listed(), its names are taken and the driver lists nothing.
    """
    names, plain = names or LAYOUTS[layout][0], lambda file: F.regexp_replace(file, "^file:/*", "/")
    if listing is None:
        files = _files(spark, path, names).select(*located(layout, home), "length")
        archives = _files(spark, path, names).where(F.col("path").endswith(".zst") & (F.col("length") <= _MOST))
        walked = archives.select(plain("_metadata.file_path").alias("_archive"), "content").mapInArrow(_walked, "_archive string, _whole boolean")
    else:
        files = listing.select(*located(layout, home, F.col("file"), F.timestamp_micros("modified")), "length")
        archives = listing.where(F.col("file").endswith(".zst") & (F.col("length") <= _MOST))
        walked = dealt_files(archives).select(F.col("file").alias("_archive")).mapInArrow(_walked_at(path.rstrip("/")), "_archive string, _whole boolean")
        walked = walked.select(plain("_archive").alias("_archive"), "_whole")
    filled = ~is_blank(F.col("value"))
    came = lines.groupBy(F.col("file").alias("_file")).agg(
        F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).alias("_bytes"), F.max_by(F.when(filled, is_object(F.col("value"))), F.when(filled, F.col("pos"))).alias("_sound"),
    )
    # A row for each file: a table of names is small as it is stored, so its size must not have these sent to all.
    rows = files.join(came.hint("merge"), F.col("file") == F.col("_file"), "left").join(walked.hint("merge"), F.col("file") == F.col("_archive"), "left")
    return rows.select("agent", "home", "session_id", "file", "length", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), _state().alias("state"))


def rejects(files: DataFrame) -> DataFrame:
    """Rejects (agent, home, session_id, reason) for files that did not come whole; a cut line is no reject but a truncation."""
    lost = files.where(F.col("state").isin("unreadable", "cut archive", "cut short"))
    return lost.select("agent", "home", "session_id", F.concat(F.lit("file did not come whole ("), "state", F.lit("): "), "file").alias("reason"))


def with_truncation(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """A catalog with `file`, whose `truncated` also holds for files that did not come whole."""
    bad = files.where("state not in ('whole', 'unchecked')").select(F.col("file").alias("_bad"))
    return catalog.join(bad, F.col("file") == F.col("_bad"), "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)) | F.col("_bad").isNotNull()).drop("_bad")
