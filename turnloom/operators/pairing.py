"""Calls and the results that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.redact import redact_text
from turnloom.plans.transfer import BODY_DROPPED

SESSION = ["agent", "home", "session_id"]
# Tool names by layout and effect; a name in neither set is "unknown", a shell too.
EFFECTS = {
    ("claude-code", "mutating"): ("Write", "Edit", "MultiEdit", "NotebookEdit"),
    ("claude-code", "read-only"): ("Read", "Grep", "Glob", "LS", "NotebookRead", "WebFetch", "WebSearch", "TodoRead"),
    ("codex", "mutating"): ("apply_patch", "write_file", "edit_file", "create_file", "delete_file"),
    ("codex", "read-only"): ("read_file", "read", "view_image", "list_dir", "grep", "find", "web_search"),
    ("pi", "mutating"): ("write", "edit", "multiedit", "apply_patch", "applypatch", "patch", "create", "delete", "remove", "move", "rename", "mkdir", "notebookedit"),
    ("pi", "read-only"): ("read", "ls", "list", "find", "glob", "grep", "search", "tree", "fetch", "webfetch", "web_search", "websearch"),
}


def effect_of(tool: Column, layout: str) -> Column:
    """mutating, read-only or unknown; one layout compares names without case and outer space."""
    name = F.lower(F.trim(tool)) if layout == "pi" else tool
    found = F.lit("unknown")
    for effect in ("read-only", "mutating"):
        found = F.when(name.isin(*EFFECTS.get((layout, effect), ())), F.lit(effect)).otherwise(found)
    return F.when(tool.isNull(), F.lit(None).cast("string")).otherwise(found)


def effects(calls: DataFrame, table: DataFrame, default: str = "unknown") -> DataFrame:
    """calls with `effect` from a table (agent, tool_name, effect) of any size."""
    known = table.select("agent", "tool_name", F.col("effect").alias("_e")).dropDuplicates(["agent", "tool_name"])
    return calls.join(known, ["agent", "tool_name"], "left").withColumn("effect", F.coalesce("_e", F.lit(default))).drop("_e")


def last_results(results: DataFrame) -> DataFrame:
    """One result per call id: the last in file order, by an aggregate that combines before the shuffle."""
    columns = [c for c in results.columns if c not in (*SESSION, "call_id", "pos")]
    best = results.groupBy(*SESSION, "call_id").agg(F.max(F.struct("pos", *columns)).alias("r"))
    return best.select(*SESSION, "call_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call with its result's columns and result_recorded; an empty result still counts as recorded."""
    found = last_results(results).withColumn("result_recorded", F.lit(True))
    return calls.join(found, [*SESSION, "call_id"], "left").withColumn("result_recorded", F.coalesce("result_recorded", F.lit(False)))


def _sized(body: Column, none: int) -> Column:
    n = F.when(body == "", F.lit(none)).otherwise(F.size(F.split(body, "\n", -1)))
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" line")).otherwise(F.lit(" lines")))


def outcome_claude(call: Column, body: Column, present: Column, error: Column, recorded: Column) -> tuple[Column, Column]:
    """The outcome line of a call with its rendered head, and whether a body was dropped."""
    has_body = body.isNotNull()
    size = _sized(body, 0)
    text = (
        F.when(~recorded, F.lit("no result recorded"))
        .when(has_body, F.when(error, F.concat(F.lit("error, "), size)).otherwise(size))
        .when(present, F.when(error, F.lit("error, result dropped")).otherwise(F.lit("result recorded")))
        .otherwise(F.when(error, F.lit("error")).otherwise(F.lit("no result recorded")))
    )
    dropped = recorded & F.when(has_body, body != "").otherwise(present)
    line = F.concat(call, F.lit(" → "), text)
    return redact_text(F.when(dropped, F.concat(line, F.lit(f" {BODY_DROPPED}"))).otherwise(line)), dropped


def outcome_pi(call: Column, body: Column, present: Column, error: Column, recorded: Column) -> tuple[Column, Column]:
    """As outcome_claude() in the third layout's words."""
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    text = (
        F.when(~recorded, F.lit("no result recorded"))
        .when(blank & present, F.concat(F.when(error, F.lit("error, result dropped")).otherwise(F.lit("result recorded")), F.lit(f" {BODY_DROPPED}")))
        .when(blank, F.when(error, F.lit("error")).otherwise(F.lit("no output")))
        .otherwise(F.concat(F.when(error, F.lit("error")).otherwise(_sized(body, 1)), F.lit(f" {BODY_DROPPED}")))
    )
    dropped = recorded & (~blank | present)
    return redact_text(F.trim(F.regexp_replace(F.concat(call, F.lit(" → "), text), r"\s+", " "))), dropped


def outcome_codex(call: Column, output: Column) -> tuple[Column, Column]:
    """As outcome_claude() for calls whose output alone is known (null: none)."""
    text = F.when(output.isNull(), F.lit("no output recorded")).otherwise(F.concat(F.size(F.split(output, "\n", -1)).cast("string"), F.lit(" lines, body dropped")))
    return redact_text(F.concat(call, F.lit(" → "), text)), output.isNotNull()
