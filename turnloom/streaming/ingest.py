"""Structured Streaming forms: file ingest, the running catalog, redaction and cost, call pairing, snapshot upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.redact import redacted
from turnloom.functions.tokens import turn_cost
from turnloom.operators.catalog import newest
from turnloom.sources.growing import GrowingLines
from turnloom.sources.lines import LAYOUTS, is_object, located

SESSION = ["agent", "home", "session_id"]


def stream_lines(spark: SparkSession, path: str, layout: str, home: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """New files' lines with the columns of sources.lines.scan(), and whether they are JSON objects.

    Files are taken whole (wholetext), as places of lines need; a file that grows later must come as a new one. Files that
    grow are followed by stream_growing_lines().
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", LAYOUTS[layout][0])
    files = reader.text(path, wholetext=True).select(*located(layout, home), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("_lines"))
    rows = files.select("agent", "home", "session_id", "file", "file_time", F.posexplode("_lines").alias("pos", "value"))
    return rows.select("agent", "home", "session_id", "file", "value", "file_time", F.col("pos").cast("long").alias("pos"), is_object(F.col("value")).alias("good"))


def stream_growing_lines(spark: SparkSession, path: str, layout: str, state: str, home: str | None = None, settle: float | None = None, names: str | None = None) -> DataFrame:
    """Lines as they are appended to files, with the columns of stream_lines(); see sources.growing.

    `state` is a folder that driver and executors share and that belongs to the stream's checkpoint.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path).option("state", state).option("names", names or LAYOUTS[layout][0])
    if settle is not None:
        reader = reader.option("settle", str(settle))
    rows = reader.load().select(*located(layout, home, F.col("file"), F.timestamp_micros("modified")), "pos", "value")
    return rows.select("agent", "home", "session_id", "file", "value", "file_time", "pos", is_object(F.col("value")).alias("good"))


def stream_catalog(turns: DataFrame) -> DataFrame:
    """Sessions as far as they have come: title from the first request, first and last times, number of turns.

    For update or complete mode. The state is one row per session. Which older calls count in files of both eras needs
    the whole file, so that rule stays with the batch reader.
    """
    asked = (F.col("role") == "user") & (F.col("kind") == "message")
    return turns.groupBy(*SESSION).agg(
        F.min(F.when(asked, F.struct("idx", "text"))).getField("text").alias("request"),
        F.min(F.when(F.col("ts").isNotNull(), F.struct("idx", "ts"))).getField("ts").alias("started_at"),
        F.max(F.when(F.col("ts").isNotNull(), F.struct("idx", "ts"))).getField("ts").alias("updated_at"),
        F.count("*").alias("turn_count"),
    )


def stream_redacted(turns: DataFrame) -> DataFrame:
    """Turns with redacted text and their cost: the same expressions as in batch, row by row."""
    return redacted(turns, "text").withColumn("cost", turn_cost())


def stream_paired(calls: DataFrame, results: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls (keys, call_id, called_at) with the result (answered_at, body) within `wait`; unanswered ones after the watermark.

    A stream-stream left join: state is dropped once the watermark is past a call's wait.
    """
    left = calls.withWatermark("called_at", late)
    right = results.select(*[F.col(c).alias(f"r_{c}") for c in (*SESSION, "call_id")], "answered_at", "body").withWatermark("answered_at", late)
    same = [F.col(c) == F.col(f"r_{c}") for c in (*SESSION, "call_id")]
    within = (F.col("answered_at") >= F.col("called_at")) & (F.col("answered_at") <= F.col("called_at") + F.expr(f"interval {wait}"))
    condition = same[0] & same[1] & same[2] & same[3] & within
    joined = left.join(right, condition, "left_outer").drop(*[f"r_{c}" for c in (*SESSION, "call_id")])
    return joined.withColumn("result_recorded", F.col("answered_at").isNotNull())


def upsert_snapshots(path: str):
    """A foreachBatch function that keeps, of every session, the row of the latest updated_at in versions below a path.

    Each batch writes a whole new version, so a lost executor or a repeated batch never leaves half a table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        newest(rows).write.mode("overwrite").parquet(f"{path}/version={number}")

    return run


def with_open_calls(paired: DataFrame, calls: DataFrame) -> DataFrame:
    """paired, a result of stream_paired(), with the calls that its watermark has not passed yet, as unanswered.

    calls are the stream's calls as a table; results that matched have come out at once, so the rest has none so far.
    """
    keys = [*SESSION, "call_id"]
    rest = calls.join(paired.select(*keys).distinct(), keys, "left_anti")
    return paired.unionByName(rest.withColumn("result_recorded", F.lit(False)), allowMissingColumns=True)


def available_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet files below a new folder, and returns them as a table.

    In complete mode each batch writes a whole version, and the last one counts.
    """
    spark, state = stream.sparkSession, {"version": None}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")
        state["version"] = number

    writer.foreachBatch(version).start().awaitTermination()
    if state["version"] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/version={state['version']}")
