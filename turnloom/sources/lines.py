"""Scans of session files as lines, and strict reading of lines as JSON objects.

A lines table has agent, home, session_id, file, pos (the line's place in its file), value and file_time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.text import WIDE_SPACE, iso_utc

#: Longer lines are dropped whole and mark their file as cut.
MOST_LINE = 16 * 1024 * 1024
LAYOUTS = {
    # layout: (glob of file names, pattern of the session's id in the path, pattern of the home)
    "claude-code": ("*.jsonl", r"([^/]+)\.jsonl$", r"^(.*)/projects/"),
    "codex": ("rollout-*.jsonl*", r"rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-(.+?)\.jsonl(?:\.zst)?$", r"^(.*)/(?:archived_)?sessions/"),
    "pi": ("*.jsonl", r"/[^/_]*_([^/]+)\.jsonl$", r"^(.*?)/[^/]*sessions[^/]*/"),
}


def located(layout: str, home: str | None = None, file: Column | None = None, modified: Column | None = None) -> list[Column]:
    """agent, home, session_id, file and file_time of a row that was read from a file of a layout."""
    _, identity, root = LAYOUTS[layout]
    file = F.regexp_replace(F.col("_metadata.file_path") if file is None else file, "^file:/*", "/")
    modified = F.col("_metadata.file_modification_time") if modified is None else modified
    return [
        F.lit(layout).alias("agent"), (F.lit(home) if home else F.regexp_extract(file, root, 1)).alias("home"), F.regexp_extract(file, identity, 1).alias("session_id"),
        file.alias("file"), iso_utc(modified).alias("file_time"),
    ]


def scan(spark: SparkSession, path: str, layout: str, home: str | None = None, modified_after: datetime | None = None, names: str | None = None) -> DataFrame:
    """The lines of every file of a layout below a path; .zst archives are read as they are.

    Files that can't be read are skipped; unreadable() names them, and integrity.partial_files() those read in part.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names or LAYOUTS[layout][0]).option("ignoreCorruptFiles", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    raw = reader.text(path).select(*located(layout, home), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    order = Window.partitionBy("file").orderBy("_block", "_row")
    return raw.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).select("agent", "home", "session_id", "file", "value", "file_time", "pos")


def unreadable(spark: SparkSession, path: str, layout: str, lines: DataFrame, home: str | None = None) -> DataFrame:
    """Rejects (agent, home, session_id, reason) for the files below a path that are not empty but gave no line.

    Only names and sizes are read: no file's content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", LAYOUTS[layout][0])
    files = reader.load(path).select(*located(layout, home), "length").where("length > 0")
    read = lines.select(F.col("file").alias("_read")).distinct()
    lost = files.join(read, F.col("file") == F.col("_read"), "left_anti")
    return lost.select("agent", "home", "session_id", F.concat(F.lit("file could not be read: "), "file").alias("reason"))


def scan_homes(spark: SparkSession, homes: list[tuple[str, str, str]]) -> tuple[DataFrame | None, DataFrame]:
    """Lines of several (layout, home, path), each home once; and rejects for those whose path does not exist."""
    rows, missing, seen = None, [], set()
    for layout, home, path in homes:
        if (layout, home) in seen:
            continue
        seen.add((layout, home))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            missing.append((layout, home, None, f"home {home} does not exist"))
            continue
        one = scan(spark, path, layout, home)
        rows = one if rows is None else rows.unionByName(one)
    return rows, spark.createDataFrame(missing, "agent string, home string, session_id string, reason string")


def is_blank(value: Column) -> Column:
    return F.regexp_replace(value, f"[{WIDE_SPACE}]+", "") == ""


def is_object(value: Column) -> Column:
    """Whether a line is exactly one JSON object; trailing text, arrays and single quotes are not."""
    one = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(one) == 1) & F.ltrim(value).startswith("{"), F.lit(False))


def checked(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with `good`; those over MOST_LINE are bad and lose their text."""
    short = F.length("value") <= MOST_LINE
    rows = lines.where(~is_blank(F.col("value"))).withColumn("good", F.when(short, is_object(F.col("value"))).otherwise(F.lit(False)))
    return rows.withColumn("value", F.when(short, F.col("value")).otherwise(F.lit("")))


def identified(lines: DataFrame) -> DataFrame:
    """Per file the layout that it identifies itself as, or null."""
    head = F.from_json("value", "type string, uuid string, sessionId string, id string, payload struct<id: string, session_id: string>")
    rows = checked(lines).where("good").select("file", "pos", head.alias("e"))
    flags = rows.groupBy("file").agg(
        F.bool_or(F.col("e.uuid").isNotNull() & F.col("e.sessionId").isNotNull()).alias("claude"),
        F.min_by(F.coalesce((F.col("e.type") == "session") & (F.col("e.id") != ""), F.lit(False)), "pos").alias("pi"),
        F.bool_or(F.coalesce((F.col("e.type") == "session_meta") & (F.coalesce("e.payload.id", "e.payload.session_id") != ""), F.lit(False))).alias("codex"),
    )
    return flags.select("file", F.when(F.col("codex"), "codex").when(F.col("pi"), "pi").when(F.col("claude"), "claude-code").alias("layout"))
