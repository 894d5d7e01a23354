"""Session files with a header line and entries linked by id and parentId, compacted as the agent would see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.redact import redact_arguments, redact_text, redacted
from turnloom.functions.text import cut_within, is_absolute, iso_utc, one_line, parsed_iso
from turnloom.operators.branch import active_path, compacted, off_path
from turnloom.operators.catalog import first_known
from turnloom.operators.pairing import effect_of, last_results, outcome_pi
from turnloom.session import written
from turnloom.sources.claude import visible
from turnloom.sources.lines import checked, is_blank

SESSION = ["agent", "home", "session_id"]
UNREADABLE = "(unreadable) "
# Entry types that are known to carry no turn, and argument names that hold a path.
SILENT = ("model_change", "thinking_level_change", "custom", "label", "session_info")
_PATHS = ("path", "file_path", "filePath", "file", "target")
_ENTRY = "type string, id string, parentId string, timestamp string, summary string, name string, firstKeptEntryId string, retainedTail array<string>, message string"
_BLOCK = "type: string, text: string, id: string, name: string, arguments: string"


def entries(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, entries, rejects): the first line is the header; bad lines or a missing header reject the file."""
    rows = checked(lines)
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy(*SESSION).orderBy("pos")))
    rows = rows.withColumn("e", F.when(F.col("good"), F.from_json("value", _ENTRY + ", cwd string")))
    is_head = (F.col("line") == 1) & (F.col("e.type") == "session") & (F.col("e.id") != "")
    rows = rows.withColumn("head", F.coalesce(is_head, F.lit(False)))
    heads = rows.where("head").select(*SESSION, "file", "file_time", F.col("e.id").alias("recorded_id"), parsed_iso(F.col("e.timestamp")).alias("began"), F.col("e.cwd").alias("cwd"))
    bad = ~F.col("head") & F.col("e.type").isNull()
    flags = rows.groupBy(*SESSION).agg(F.bool_or("head").alias("headed"), F.bool_or(F.coalesce(bad | (F.col("e.type") == ""), F.lit(True))).alias("cut"))
    rejects = flags.where("cut or not headed").select(*SESSION, F.when(~F.col("headed"), F.lit("the file has no session header")).otherwise(F.lit("a line is not a session entry")).alias("reason"))
    stamp = F.coalesce(parsed_iso(F.col("e.timestamp")), iso_utc(F.timestamp_millis(F.expr("try_cast(e.timestamp as bigint)"))))
    body = rows.where(~F.col("head") & (F.col("e.type") != "")).select(
        *SESSION, "pos", F.col("e.type").alias("type"), F.col("e.id").alias("id"), F.col("e.parentId").alias("parent"), stamp.alias("stamp"), F.col("e.summary").alias("summary"),
        F.col("e.name").alias("name"), F.col("e.firstKeptEntryId").alias("first_kept"), F.filter("e.retainedTail", lambda x: x.startswith("{")).alias("retained"), F.col("e.message").alias("message"),
    )
    return heads, body, rejects


def paths(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live path as of active_path(), entries that it leaves out as of off_path()) of the files' lines."""
    _, body, cut = entries(lines)
    body, cut = written(body, "pi-entries"), written(cut, "pi-rejects")
    path, _ = active_path(body.join(cut.select(*SESSION), SESSION, "left_anti"), "id")
    return path, off_path(body, path)


def turns(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, catalog, rejects) of the files' lines."""
    heads, body, cut = entries(lines)
    body, cut = written(body, "pi-entries"), written(cut, "pi-rejects")
    sound = body.join(cut.select(*SESSION), SESSION, "left_anti")
    path, wrong = active_path(sound, "id")
    rejects = cut.unionByName(wrong)
    live = sound.join(path, [*SESSION, "pos"])
    context = compacted(live).withColumn("message", F.coalesce("item", "message")).withColumn("type", F.when(F.col("item").isNotNull(), F.lit("message")).otherwise(F.col("type")))
    message = F.from_json("message", "role string, content string, toolCallId string, isError boolean")
    blocks = F.from_json("message", f"content array<struct<{_BLOCK}>>")["content"]
    context = context.withColumns({"m": message, "blocks": blocks, "row": F.struct("part", "place")})
    context = written(context, "pi-context")

    listed = F.col("blocks").isNotNull()
    text = F.when(listed, visible(F.col("blocks"))).otherwise(F.when(~F.coalesce(F.col("m.content").startswith("{"), F.lit(False)), F.col("m.content")))
    present = F.when(listed, F.size("blocks") > 0).otherwise(F.coalesce(F.col("m.content") != "", F.lit(False)))
    results = context.where((F.col("m.role") == "toolResult") & (F.col("m.toolCallId") != "")).select(
        *SESSION, F.col("m.toolCallId").alias("call_id"), (F.col("part") * (1 << 40) + F.col("place")).alias("pos"), F.coalesce(text, F.lit("")).alias("body"), present.alias("present"), F.coalesce("m.isError", F.lit(False)).alias("error"),
    )
    answers = last_results(results).withColumn("recorded", F.lit(True))
    summed = F.col("type").isin("compaction", "branch_summary") & ~is_blank(F.coalesce("summary", F.lit("")))
    user = (F.col("m.role") == "user") & (F.col("type") == "message") & ~is_blank(F.coalesce(text, F.lit("")))
    talk = (F.col("m.role") == "assistant") & ~listed & ~is_blank(F.coalesce(text, F.lit("")))
    single = context.where(summed | user | talk).select(
        *SESSION, "row", F.lit(0).alias("n"), "stamp", F.when(user, F.lit("user")).otherwise(F.lit("agent")).alias("role"), F.when(summed, F.lit("summary")).otherwise(F.lit("message")).alias("kind"),
        F.when(summed, F.col("summary")).otherwise(text).alias("text"),
    )
    parts = context.where((F.col("m.role") == "assistant") & listed).select(*SESSION, "row", "stamp", F.posexplode("blocks").alias("n", "b"))
    is_call = F.coalesce((F.col("b.type") == "toolCall"), F.lit(False))
    order = Window.partitionBy(*SESSION).orderBy("row", "n")
    parts = parts.withColumns({"use": is_call, "run": F.sum(is_call.cast("int")).over(order)})
    joined_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("b.text").alias("t")))), lambda x: x.t), "\n")
    texts = parts.where((F.col("b.type") == "text") & F.col("b.text").isNotNull()).groupBy(*SESSION, "row", "run").agg(F.min("n").alias("n"), F.first("stamp").alias("stamp"), joined_text.alias("text"))
    texts = texts.where(~is_blank(F.col("text"))).select(*SESSION, "row", "n", "stamp", F.lit("agent").alias("role"), F.lit("message").alias("kind"), "text")
    calls = parts.where(F.col("use") & F.col("b.name").isNotNull()).select(
        *SESSION, "row", "n", "stamp", F.lit("agent").alias("role"), F.lit("tool-call").alias("kind"), F.lit("").alias("text"), F.col("b.name").alias("tool_name"), F.coalesce("b.id", F.lit("")).alias("call_id"),
        F.when(F.col("b.arguments").startswith("{"), F.col("b.arguments")).otherwise(F.lit("{}")).alias("input"),
    )
    rows = single.unionByName(texts).unionByName(calls, allowMissingColumns=True).join(answers, [*SESSION, "call_id"], "left")
    rows = redacted(rows, "text").withColumn("arguments_text", F.when(F.col("tool_name").isNotNull(), redact_arguments(F.col("input"))))
    tool, recorded = F.col("tool_name").isNotNull(), F.coalesce("recorded", F.lit(False))
    head = F.concat("tool_name", F.lit("("), cut_within(one_line(F.col("arguments_text")), 60), F.lit(")"))
    line, dropped = outcome_pi(head, F.col("body"), F.coalesce("present", F.lit(False)), F.coalesce("error", F.lit(False)), recorded)
    effect = effect_of(F.col("tool_name"), "pi")
    path_of = F.coalesce(*[F.nullif(F.trim(F.get_json_object("input", f"$.{k}")), F.lit("")) for k in _PATHS])
    out = rows.select(
        *SESSION, (F.row_number().over(order) - 1).cast("long").alias("idx"), "role", "kind", "text", "tool_name", "arguments_text",
        F.when(tool, line).alias("outcome_line"), effect.alias("effect"), F.when(tool, dropped).alias("body_dropped"), F.when(tool, recorded).alias("result_recorded"),
        F.col("stamp").alias("ts"), F.when(effect == "mutating", F.array_compact(F.array(path_of))).alias("changed_paths"),
    )

    m = F.from_json("message", "role string, content string")
    b = F.from_json("message", f"content array<struct<{_BLOCK}>>")["content"]
    asked = F.when((F.col("type") == "message") & (m["role"] == "user"), F.nullif(F.when(b.isNotNull(), visible(b)).otherwise(m["content"]), F.lit("")))
    facts = live.groupBy(*SESSION).agg(
        first_known(F.when((F.col("type") == "session_info") & ~is_blank(F.col("name")), F.col("name")), F.col("depth")).alias("own_name"),
        first_known(F.when(~is_blank(asked), asked), F.col("depth")).alias("request"), F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("depth"))).alias("last"),
    )
    sizes = out.groupBy(*SESSION).agg(F.count("*").alias("n"))
    files = lines.groupBy(*SESSION).agg(F.min("file").alias("file"), F.max("file_time").alias("file_time"))
    lost = rejects.select(*SESSION).distinct().withColumn("lost", F.lit(True))
    table = files.join(heads.drop("file", "file_time"), SESSION, "left").join(facts, SESSION, "left").join(sizes, SESSION, "left").join(lost, SESSION, "left")
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    title = cut_within(one_line(F.coalesce("own_name", redact_text(F.col("request")))), 80)
    gone, started = F.coalesce("lost", F.lit(False)), F.coalesce("began", "file_time")
    where = F.when(is_absolute(F.col("cwd")), F.col("cwd"))
    catalog = table.select(
        *SESSION, "file", "recorded_id", F.when(gone, F.concat(F.lit(UNREADABLE), name)).otherwise(F.coalesce(title, name)).alias("title"), started.alias("started_at"),
        F.coalesce("last", F.when(gone, F.col("file_time")).otherwise(started)).alias("updated_at"), F.when(gone, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).alias("turn_count"),
        where.alias("repo_path"), where.alias("start_directory"), F.lit(None).cast("string").alias("branch"),
    )
    return out, catalog, rejects


def skipped(context: DataFrame) -> DataFrame:
    """Per session the entries of types that are not known, with their names. context has the keys and type."""
    known = ("message", "compaction", "branch_summary", *SILENT)
    odd = context.where(~F.col("type").isin(*known))
    return odd.groupBy(*SESSION).agg(F.count("*").alias("skipped"), F.array_sort(F.collect_set("type")).alias("types"))
