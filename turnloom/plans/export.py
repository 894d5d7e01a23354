"""Kept turns as lines of the three layouts, ready to be written as text.

turns are the kept turns of plans (keys, idx, role, kind, text, tool_name, arguments_text, outcome_line, ts). sessions
has one row per session: keys, new_id, target_home, cwd, branch, commit, imported_at, updated_at, started_at,
kept_turns, marker_lines and drop_summary. Lines have keys, new_id, path, pos and value; each session's lines come
from one window over its turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import dashed_directory, framed_directory, parsed_iso, seeded_uuid
from turnloom.sources.lines import is_blank

SESSION = ["agent", "home", "session_id"]
EPOCH = "1970-01-01T00:00:00.000Z"
# Names and numbers that the layouts' readers expect.
CLAUDE_VERSION, CLAUDE_MODEL, CLAUDE_EMPTY = "2.1.220", "<synthetic>", "(empty message)"
CODEX_ORIGIN, CODEX_VERSION = "turnloom", "0.146.0"
PI_VERSION, PI_EMPTY, PI_MARKER, PI_API, PI_PROVIDER, PI_MODEL = 3, "(empty turn)", "turnloom-provenance", "pi-virtual", "turnloom", "imported-session"
_KEEP_NULLS = {"ignoreNullFields": "false"}


def new_ids(sessions: DataFrame, target: str) -> DataFrame:
    """sessions with new_id, the same for a session and target on every run."""
    return sessions.withColumn("new_id", seeded_uuid(F.concat_ws("/", *SESSION, F.lit(target)), F.lit(0)))


def not_yet_stored(sessions: DataFrame, stored: DataFrame) -> DataFrame:
    """The sessions whose new_id no stored session has: nothing is ever overwritten."""
    return sessions.join(stored.select("new_id").distinct(), "new_id", "left_anti")


def fallback_stamp() -> Column:
    return F.coalesce(parsed_iso(F.col("imported_at")), parsed_iso(F.col("updated_at")), parsed_iso(F.col("started_at")), F.lit(EPOCH))


def _said(empty: str | None, full_call: bool) -> Column:
    """What a turn says: a call its outcome line, with name and arguments before it where the line does not name the call."""
    outcome = F.coalesce("outcome_line", F.lit(""))
    named = F.concat(F.col("tool_name"), F.lit("("), F.coalesce("arguments_text", F.lit("")), F.lit(") → "), outcome)
    call = F.when(F.contains(outcome, F.col("tool_name")), outcome).otherwise(named) if full_call else outcome
    text = F.when((F.col("kind") == "tool-call") & F.col("tool_name").isNotNull(), call).otherwise(F.coalesce("text", F.lit("")))
    return F.when(is_blank(text), F.lit(empty)).otherwise(text) if empty else text


def _facts(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("fallback", fallback_stamp())


def _joined(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    return turns.select(*SESSION, "idx", "role", "kind", "text", "tool_name", "arguments_text", "outcome_line", F.col("ts").alias("stamp")).join(_facts(sessions), SESSION)


def _place() -> Column:
    """The turn's number in its session, from 1: the first line is the marker's or the header's."""
    return F.row_number().over(Window.partitionBy(*SESSION).orderBy("idx")).cast("long")


def claude_lines(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """A marker entry and one entry per turn, chained by seeded ids."""
    path = F.concat("target_home", F.lit("/projects/"), dashed_directory(F.col("cwd")), F.lit("/"), F.col("new_id"), F.lit(".jsonl"))

    def envelope(place: Column, parent: Column, stamp: Column) -> list[Column]:
        return [
            parent.alias("parentUuid"), F.lit(False).alias("isSidechain"), F.lit("external").alias("userType"), F.col("cwd"), F.col("new_id").alias("sessionId"),
            F.lit(CLAUDE_VERSION).alias("version"), F.coalesce("branch", F.lit("")).alias("gitBranch"), seeded_uuid(F.col("new_id"), place).alias("uuid"), stamp.alias("timestamp"),
        ]

    first = F.struct(
        *envelope(F.lit(0), F.lit(None).cast("string"), F.coalesce(parsed_iso(F.col("imported_at")), F.lit(EPOCH))), F.lit("system").alias("type"), F.lit("informational").alias("subtype"),
        F.lit("info").alias("level"), F.lit(False).alias("isMeta"), F.array_join("marker_lines", "\n").alias("content"),
    )
    heads = sessions.select(*SESSION, "new_id", path.alias("path"), F.lit(0).cast("long").alias("pos"), F.to_json(first, _KEEP_NULLS).alias("value"))
    rows = _joined(turns, sessions).withColumn("place", _place()).withColumn("said", _said(CLAUDE_EMPTY, True))
    stamp = F.coalesce(parsed_iso(F.col("stamp")), parsed_iso(F.col("imported_at")), parsed_iso(F.col("updated_at")), F.lit(EPOCH))
    common = envelope(F.col("place"), seeded_uuid(F.col("new_id"), F.col("place") - 1), stamp)
    user = F.struct(*common, F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), F.col("said").alias("content")).alias("message"))
    usage = F.struct(*[F.lit(0).alias(n) for n in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")], F.lit("standard").alias("service_tier"))
    message = F.struct(
        F.concat(F.lit("msg_"), F.substring(F.regexp_replace(seeded_uuid(F.col("new_id"), F.col("place")), "-", ""), 1, 24)).alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.lit(CLAUDE_MODEL).alias("model"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))).alias("content"), F.lit("end_turn").alias("stop_reason"), F.lit(None).cast("string").alias("stop_sequence"), usage.alias("usage"),
    )
    agent = F.struct(*common, F.lit("assistant").alias("type"), message.alias("message"))
    value = F.when(F.col("role") == "user", F.to_json(user, _KEEP_NULLS)).otherwise(F.to_json(agent, _KEEP_NULLS))
    return heads.unionByName(rows.select(*SESSION, "new_id", path.alias("path"), F.col("place").alias("pos"), value.alias("value")))


def codex_lines(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session metadata and one message event for every turn that says something."""
    day = F.split(F.substring("fallback", 1, 10), "-")
    stamp = F.regexp_replace(F.substring("fallback", 1, 19), ":", "-")
    path = F.concat("target_home", F.lit("/sessions/"), F.array_join(day, "/"), F.lit("/rollout-"), stamp, F.lit("-"), F.col("new_id"), F.lit(".jsonl"))
    facts = _facts(sessions)
    plain = [
        F.col("new_id").alias("id"), F.col("new_id").alias("session_id"), F.col("fallback").alias("timestamp"), F.col("cwd"), F.lit(CODEX_ORIGIN).alias("originator"), F.lit(CODEX_VERSION).alias("cli_version"),
        F.lit("cli").alias("source"), F.lit("user").alias("thread_source"), F.lit("openai").alias("model_provider"),
    ]
    git = F.struct(F.col("commit").alias("commit_hash"), F.col("branch").alias("branch")).alias("git")
    entry = lambda *payload: F.to_json(F.struct(F.col("fallback").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(*payload).alias("payload")), _KEEP_NULLS)
    meta = F.when(F.col("commit").isNull() & F.col("branch").isNull(), entry(*plain)).otherwise(entry(*plain, git))
    heads = facts.select(*SESSION, "new_id", path.alias("path"), F.lit(0).cast("long").alias("pos"), meta.alias("value"))
    rows = _joined(turns, sessions).withColumn("said", _said(None, False)).where(~is_blank(F.col("said"))).withColumn("place", _place())
    none = F.array().cast("array<string>")
    at = F.coalesce("stamp", "fallback").alias("timestamp")
    user = F.struct(at, F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("said").alias("message"), none.alias("images"), none.alias("local_images"), none.alias("text_elements")).alias("payload"))
    agent = F.struct(at, F.lit("event_msg").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.col("said").alias("message"), F.lit("commentary").alias("phase"), F.lit(None).cast("string").alias("memory_citation")).alias("payload"))
    value = F.when(F.col("role") == "user", F.to_json(user, _KEEP_NULLS)).otherwise(F.to_json(agent, _KEEP_NULLS))
    return heads.unionByName(rows.select(*SESSION, "new_id", path.alias("path"), F.col("place").alias("pos"), value.alias("value")))


def pi_lines(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """A header, a marker entry, and one message entry per turn, chained by seeded ids."""
    created = F.coalesce(parsed_iso(F.col("imported_at")), F.lit(EPOCH))
    path = F.concat("target_home", F.lit("/sessions/"), framed_directory(F.col("cwd")), F.lit("/"), F.regexp_replace(created, "[:.]", "-"), F.lit("_"), F.col("new_id"), F.lit(".jsonl"))
    entry_id = lambda place: F.substring(F.sha2(F.concat_ws(":", F.col("new_id"), place.cast("string")), 256), 1, 8)
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.lit(PI_VERSION).alias("version"), F.col("new_id").alias("id"), created.alias("timestamp"), F.col("cwd")))
    data = F.struct(
        F.col("agent").alias("sourceAgent"), F.col("home").alias("sourceHome"), F.col("session_id").alias("sourceSessionId"), F.col("imported_at").alias("importedAt"),
        F.col("drop_summary").alias("droppedSummary"), F.col("marker_lines").alias("lines"),
    )
    marker = F.to_json(F.struct(F.lit("custom").alias("type"), F.lit(PI_MARKER).alias("customType"), data.alias("data"), entry_id(F.lit(1)).alias("id"), F.lit(None).cast("string").alias("parentId"), created.alias("timestamp")), _KEEP_NULLS)
    both = F.array(F.struct(F.lit(0).cast("long").alias("pos"), head.alias("value")), F.struct(F.lit(1).cast("long").alias("pos"), marker.alias("value")))
    heads = sessions.select(*SESSION, "new_id", path.alias("path"), F.explode(both).alias("l")).select(*SESSION, "new_id", "path", "l.*")
    rows = _joined(turns, sessions).withColumn("place", _place() + 1).withColumn("said", _said(PI_EMPTY, False))
    stamp = F.coalesce(parsed_iso(F.col("stamp")), parsed_iso(F.col("updated_at")), created)
    rows = rows.withColumn("at", stamp).withColumn("epoch", F.unix_millis(F.to_timestamp("at")))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))).alias("content")
    zero = lambda *names: [F.lit(0).alias(n) for n in names]
    usage = F.struct(*zero("input", "output", "cacheRead", "cacheWrite", "reasoning", "totalTokens"), F.struct(*zero("input", "output", "cacheRead", "cacheWrite", "total")).alias("cost")).alias("usage")
    user = F.struct(F.lit("user").alias("role"), content, F.col("epoch").alias("timestamp"))
    agent = F.struct(F.lit("assistant").alias("role"), content, F.lit(PI_API).alias("api"), F.lit(PI_PROVIDER).alias("provider"), F.lit(PI_MODEL).alias("model"), usage, F.lit("stop").alias("stopReason"), F.col("epoch").alias("timestamp"))
    entry = lambda m: F.to_json(F.struct(F.lit("message").alias("type"), m.alias("message"), entry_id(F.col("place")).alias("id"), entry_id(F.col("place") - 1).alias("parentId"), F.col("at").alias("timestamp")), _KEEP_NULLS)
    value = F.when(F.col("role") == "user", entry(user)).otherwise(entry(agent))
    return heads.unionByName(rows.select(*SESSION, "new_id", path.alias("path"), F.col("place").alias("pos"), value.alias("value")))


LINES = {"claude-code": claude_lines, "codex": codex_lines, "pi": pi_lines}


def item_counts(lines: DataFrame, layout: str) -> DataFrame:
    """new_id and items, the number that a stored session must have again: entries, messages only, or all but the header."""
    counts = {"claude-code": F.count("*"), "codex": F.count_if(F.col("pos") > 0), "pi": F.count_if(F.col("pos") > 0)}
    return lines.groupBy("new_id").agg(counts[layout].alias("items"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Adds text files, one folder path=... for each session file; refuses a folder that already exists."""
    placed = lines.repartition("path").sortWithinPartitions("path", "pos").select("path", "value")
    placed.write.mode("errorifexists").partitionBy("path").text(folder)


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        session, name, out, n, mark = None, None, None, 0, uuid.uuid4().hex

        def done() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/session={name}/{mark}.tmp", f"{root}/session={name}/part-0")

        for batch in batches:
            rows = zip(batch.column("session").to_pylist(), batch.column("value").to_pylist(), strict=True)
            for key, lines in groupby(rows, lambda row: row[0]):
                if out is None or key != session:
                    done()
                    session, n = key, n + 1
                    name = quote(session, safe="")
                    store.create_dir(f"{root}/session={name}", recursive=True)
                    out = store.open_output_stream(f"{root}/session={name}/{mark}.tmp")
                out.write("".join(f"{value or ''}\n" for _, value in lines).encode())
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def write_small_files(lines: DataFrame, folder: str) -> int:
    """Adds a file part-0 in a folder session=... for each session of lines (session, pos, value); returns their number.

    Tasks write the files themselves, each under another name until it is whole, so a repeated task does no harm. Spark's
    text writer takes tens of milliseconds of a core for each file. The folder is one that pyarrow.fs reads.
    """
    tasks = 4 * lines.sparkSession.sparkContext.defaultParallelism
    named = lines.select(F.coalesce("session", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("session"), "pos", "value")
    placed = named.repartition(tasks, "session").sortWithinPartitions("session", "pos").select("session", "value")
    return placed.mapInArrow(_put(folder), "n long").agg({"n": "sum"}).first()[0] or 0


def write_bundles(lines: DataFrame, folder: str) -> None:
    """Adds Parquet files (path, pos, value) of many sessions each, in the order of path and pos.

    A listing of a million sessions is then one of few files; write_lines() gives each session its own.
    """
    lines.select("path", "pos", "value").repartitionByRange("path", "pos").sortWithinPartitions("path", "pos").write.mode("errorifexists").parquet(folder)


def reconciled(lines: DataFrame, stored: DataFrame, layout: str) -> DataFrame:
    """One row per session: items sent, items stored, and whether they are the same and openable (its first line is there)."""
    sent = item_counts(lines, layout).withColumnRenamed("items", "sent")
    kept = item_counts(stored, layout).withColumnRenamed("items", "stored")
    opened = stored.where("pos = 0").select("new_id").distinct().withColumn("openable", F.lit(True))
    rows = sent.join(kept, "new_id", "full").join(opened, "new_id", "left").withColumn("openable", F.coalesce("openable", F.lit(False)))
    return rows.withColumn("ok", F.coalesce(F.col("sent") == F.col("stored"), F.lit(False)) & F.col("openable"))
