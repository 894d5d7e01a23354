"""Structural checks of exported lines: every defect, not the first, as rows (new_id, path, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import is_absolute
from turnloom.sources.lines import is_blank, is_object

_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"


def _exploded(rows: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """A defect row for every rule (condition, path below the item, message) that a row breaks."""
    at = F.concat(F.lit("items/"), F.col("pos").cast("string"))
    each = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.concat(at, F.lit(path)).alias("path"), F.lit(message).alias("message"))) for bad, path, message in rules]
    return rows.select("new_id", F.explode(F.array_compact(F.array(*each))).alias("d")).select("new_id", "d.*")


def _counted(lines: DataFrame, expected: DataFrame, items: Column) -> DataFrame:
    """Defects of sessions whose lines are not as many items as promised."""
    have = lines.groupBy("new_id").agg(items.alias("have"))
    rows = expected.select("new_id", F.col("items").alias("promised")).join(have, "new_id", "left").where(~F.col("promised").eqNullSafe(F.coalesce("have", F.lit(0))))
    message = F.concat(F.lit("the session promises "), F.col("promised").cast("string"), F.lit(" items and its lines hold "), F.coalesce("have", F.lit(0)).cast("string"))
    return rows.select("new_id", F.lit("itemCount").alias("path"), message.alias("message"))


def _text(json: Column) -> Column:
    return F.coalesce(json, F.lit("")) != ""


def claude_defects(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """Types, ids, times, the chain, the marker's shape, roles, contents, usage and model of entries; item counts."""
    shape = "type string, uuid string, parentUuid string, sessionId string, timestamp string, content string, subtype string, level string, isMeta boolean, message string"
    rows = lines.withColumn("good", is_object(F.col("value"))).withColumn("e", F.from_json("value", shape))
    order = Window.partitionBy("new_id").orderBy("pos")
    rows = rows.withColumn("before", F.lag("e.uuid").over(order)).withColumn("m", F.from_json("e.message", "role string, content string, usage string, model string"))
    whole = F.col("good")
    system, agent = F.col("e.type") == "system", F.col("e.type") == "assistant"
    no_message = whole & ~system & ~F.coalesce(F.col("e.message").startswith("{"), F.lit(False))
    has_message = whole & ~system & F.coalesce(F.col("e.message").startswith("{"), F.lit(False))
    role = F.when(agent, F.lit("assistant")).otherwise(F.lit("user"))
    rules = [
        (~whole, "", "no JSON object"),
        (whole & ~F.coalesce(F.col("e.type").isin("system", "user", "assistant"), F.lit(False)), "/type", "a type that shows no turn"),
        (whole & ~_text(F.col("e.uuid")), "/uuid", "no uuid for later entries to point at"),
        (whole & ~F.coalesce(F.col("e.timestamp").rlike(_STAMP), F.lit(False)), "/timestamp", "time not in the layout's form"),
        (whole & ~F.col("e.sessionId").eqNullSafe(F.col("new_id")), "/sessionId", "belongs to another session"),
        (whole & (F.col("pos") == 0) & F.col("e.parentUuid").isNotNull(), "/parentUuid", "first in the file, yet it has a parent"),
        (whole & (F.col("pos") > 0) & ~F.col("e.parentUuid").eqNullSafe(F.col("before")), "/parentUuid", "its parent is not the line above"),
        (whole & system & F.col("e.content").isNull(), "/content", "marker without text"),
        (whole & system & ~((F.col("e.subtype").eqNullSafe("informational")) & F.col("e.level").eqNullSafe("info") & F.col("e.isMeta").eqNullSafe(False)), "", "marker of another kind than a notice"),
        (no_message, "/message", "no message"),
        (has_message & ~F.col("m.role").eqNullSafe(role), "/message/role", "role and type disagree"),
        (has_message & (~_text(F.col("m.content")) | F.col("m.content").isin("[]", "null")), "/message/content", "message without content"),
        (has_message & agent & ~F.coalesce(F.col("m.usage").startswith("{"), F.lit(False)), "/message/usage", "an answer without usage"),
        (has_message & agent & F.col("m.model").isNull(), "/message/model", "an answer without its model"),
    ]
    return _exploded(rows, [(F.coalesce(bad, F.lit(False)), p, m) for bad, p, m in rules]).unionByName(_counted(lines, expected, F.count("*")))


def codex_defects(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """One session_meta, first, with the session's id; absolute cwd; a user message; no model history entries; counts."""
    shape = "type string, payload struct<type: string, message: string, id: string, session_id: string, cwd: string, originator: string, cli_version: string, timestamp: string>"
    rows = lines.withColumn("good", is_object(F.col("value"))).withColumn("e", F.from_json("value", shape))
    first, p = F.col("pos") == 0, F.col("e.payload")
    meta = F.col("e.type") == "session_meta"
    rules = [
        (~F.col("good"), "", "no JSON object"),
        (first & ~F.coalesce(meta, F.lit(False)), "", "metadata does not come first"),
        (first & meta & ~(p["id"].eqNullSafe(F.col("new_id")) & p["session_id"].eqNullSafe(F.col("new_id"))), "/payload/id", "metadata of another session"),
        (first & meta & ~is_absolute(p["cwd"]), "/payload/cwd", "metadata without an absolute directory"),
        (first & meta & ~_text(p["originator"]), "/payload/originator", "metadata without its originator"),
        (first & meta & ~_text(p["cli_version"]), "/payload/cli_version", "metadata without a version"),
        (first & meta & F.try_to_timestamp(p["timestamp"]).isNull(), "/payload/timestamp", "metadata whose time can't be read"),
        (F.col("e.type") == "response_item", "", "history of the model, which shows no turn"),
    ]
    said = (F.col("e.type") == "event_msg") & p["type"].isin("user_message", "agent_message")
    per = rows.groupBy("new_id").agg(F.count_if(meta).alias("metas"), F.min_by(p["message"], F.when(said & (p["type"] == "user_message"), F.col("pos"))).alias("asked"))
    many = per.where("metas <> 1").select("new_id", F.lit("items").alias("path"), F.lit("metadata not exactly once").alias("message"))
    mute = per.where(F.col("asked").isNull() | is_blank(F.col("asked"))).select("new_id", F.lit("items").alias("path"), F.lit("nothing that a user asked").alias("message"))
    counts = _counted(rows, expected, F.count_if(said))
    return _exploded(rows, [(F.coalesce(bad, F.lit(False)), a, m) for bad, a, m in rules]).unionByName(many).unionByName(mute).unionByName(counts)


def pi_defects(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """The header's id; type, id, parent and time of entries; usage numbers of assistant messages; counts."""
    shape = "type string, id string, parentId string, timestamp string, message string"
    usage = "usage string"
    rows = lines.withColumn("good", is_object(F.col("value"))).withColumn("e", F.from_json("value", shape))
    rows = rows.withColumn("m", F.from_json("e.message", f"role string, {usage}"))
    number = lambda path: F.expr(f"try_cast(get_json_object(m.usage, '$.{path}') as double)").isNull()
    first, entry = F.col("good") & (F.col("pos") == 0), F.col("good") & (F.col("pos") > 0)
    has_usage = F.coalesce(F.col("m.usage").startswith("{"), F.lit(False))
    agent = entry & (F.col("e.type") == "message") & (F.col("m.role") == "assistant")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    rules = [
        (~F.col("good"), "", "no JSON object"),
        (first & ~((F.col("e.type") == "session") & _text(F.col("e.id"))), "", "no header in the first line"),
        (first & (F.col("e.type") == "session") & (F.col("e.id") != F.col("new_id")), "/id", "header of another session"),
        (entry & ~_text(F.col("e.type")), "", "no type"),
        (entry & ~_text(F.col("e.id")), "/id", "no id for later entries to hang on"),
        (entry & ~F.array_contains(keys, "parentId"), "/parentId", "no field that names its parent"),
        (entry & F.try_to_timestamp("e.timestamp").isNull(), "/timestamp", "time that can't be read"),
        (entry & (F.col("e.type") == "message") & ~F.coalesce(F.col("e.message").startswith("{"), F.lit(False)), "/message", "type message, but none in it"),
        (agent & ~has_usage, "/usage", "an answer without usage"),
        *[(agent & has_usage & number(n), f"/usage/{n.replace('.', '/')}", f"no number") for n in ("input", "output", "cacheRead", "cacheWrite", "totalTokens", "cost.total")],
    ]
    return _exploded(rows, [(F.coalesce(bad, F.lit(False)), a, m) for bad, a, m in rules]).unionByName(_counted(lines, expected, F.count_if(F.col("pos") > 0)))


DEFECTS = {"claude-code": claude_defects, "codex": codex_defects, "pi": pi_defects}
