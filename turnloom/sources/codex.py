"""Rollout files: both eras of the layout as canonical turns.

Every line is {timestamp, type, payload}. Each entry is classified by itself; only which calls of the older era count
needs the whole file: all of them without item turns, else those before the first item turn of a file that also has
older messages before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.redact import redact_arguments, redact_text, redacted
from turnloom.functions.text import cut_within, first_visible_line, is_absolute, one_line, parsed_iso
from turnloom.operators.pairing import effect_of, last_results, outcome_codex
from turnloom.sources.lines import checked, is_blank

SESSION = ["agent", "home", "session_id"]
# Names of the layout.
KNOWN = ("session_meta", "event_msg", "response_item", "turn_context", "world_state", "compacted", "inter_agent_communication_metadata")
ITEM_TOOLS = ("CommandExecution", "FileChange", "Extension", "McpToolCall", "CollabAgentToolCall", "ImageView")
ITEM_SILENT = ("Reasoning", "ContextCompaction", "SubAgentActivity")
_PAYLOAD = (
    "type string, message string, id string, session_id string, timestamp string, cwd string, git struct<commit_hash: string, branch: string>, "
    "item string, call_id string, name string, arguments string, input string, output string"
)
_ITEM = (
    "type string, content array<struct<text: string>>, command string, aggregated_output string, formatted_output string, stdout string, changes string, "
    "kind string, action struct<queries: array<string>>, query string, results array<string>, server string, tool string, arguments string, status string, "
    "result string, receiver_agents array<string>, receiver_thread_ids array<string>, agents_states string, path string"
)


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def _keys(json: Column) -> Column:
    return F.filter(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), lambda k: k != "")


def entries(lines: DataFrame) -> DataFrame:
    """Classified entries: keys, pos, stamp, class (message, summary, call, item-call, none, unknown), role, text, p, i."""
    shape = F.from_json("value", "timestamp string, type string, payload string")
    rows = checked(lines).withColumn("e", F.when(F.col("good"), shape))
    rows = rows.withColumn("cut_line", F.col("e.type").isNull())
    rows = rows.select(*SESSION, "file", "file_time", "pos", "cut_line", F.col("e.timestamp").alias("raw_stamp"), F.col("e.type").alias("type"), F.from_json(F.col("e.payload"), _PAYLOAD).alias("p"))
    is_item = (F.col("type") == "event_msg") & (F.col("p.type") == "item_completed") & F.col("p.item").startswith("{")
    rows = rows.withColumn("i", F.when(is_item, F.from_json("p.item", _ITEM)))
    item_text = F.array_join(F.filter(F.transform(F.col("i.content"), lambda part: part.text), lambda t: t.isNotNull() & (t != "")), "\n")
    item_role = F.when(F.col("i.type") == "UserMessage", F.lit("user")).when(F.col("i.type") == "AgentMessage", F.lit("agent"))
    said = F.col("p.type").isin("user_message", "agent_message") & ~is_blank(F.col("p.message"))
    called = F.col("p.type").isin("function_call", "custom_tool_call") & (F.col("p.name") != "")
    kind = (
        F.when(F.col("cut_line"), F.lit("cut")).when(~F.col("type").isin(*KNOWN), F.lit("unknown"))
        .when(F.col("type") == "compacted", F.when(~is_blank(F.col("p.message")), F.lit("summary")).otherwise(F.lit("none")))
        .when(F.col("i").isNotNull(), F.when(item_role.isNotNull(), F.when(is_blank(F.coalesce(item_text, F.lit(""))), F.lit("none")).otherwise(F.lit("item-message")))
              .when(F.col("i.type").isin(*ITEM_TOOLS), F.lit("item-call")).when(F.col("i.type").isin(*ITEM_SILENT), F.lit("none")).otherwise(F.lit("unknown")))
        .when((F.col("type") == "event_msg") & said, F.lit("message")).when((F.col("type") == "response_item") & called, F.lit("call")).otherwise(F.lit("none"))
    )
    role = F.when(kind == "item-message", item_role).when(F.col("p.type") == "user_message", F.lit("user")).otherwise(F.lit("agent"))
    text = F.when(kind == "item-message", item_text).when(kind.isin("message", "summary"), F.col("p.message"))
    return rows.withColumns({"class": kind, "role": role, "text": text, "stamp": parsed_iso(F.col("raw_stamp"))})


def in_scope(rows: DataFrame) -> DataFrame:
    """Entries without the older era's calls that repeat items. rows has keys, pos and class."""
    whole = Window.partitionBy(*SESSION)
    cut = F.min(F.when(F.col("class").isin("item-message", "item-call"), F.col("pos"))).over(whole)
    marked = rows.withColumn("_cut", cut)
    spoken = F.bool_or((F.col("class") == "message") & (F.col("pos") < F.col("_cut"))).over(whole)
    marked = marked.withColumn("_spoken", F.coalesce(spoken, F.lit(False)))
    keep = (F.col("class") != "call") | F.col("_cut").isNull() | (F.col("_spoken") & (F.col("pos") < F.col("_cut")))
    return marked.where(keep).drop("_cut", "_spoken")


def _head(tool: Column, arguments: Column) -> Column:
    return F.concat(tool, F.lit("("), cut_within(one_line(arguments), 60), F.lit(")"))


def _item_record() -> dict[str, Column]:
    """tool_name, raw arguments, stated outcome (null for commands), output (commands), effect and dropped body of an item."""
    i = lambda name: F.col(f"i.{name}")
    kind = i("type")
    argv = F.when(i("command").startswith("["), F.array_join(F.from_json(i("command"), "array<string>"), " ")).otherwise(F.coalesce(i("command"), F.lit("")))
    changes = F.from_json(i("changes"), "map<string, struct<type: string, content: string>>")
    paths = _keys(i("changes"))

    def patch(path: Column) -> Column:
        change = F.element_at(changes, path)
        verb = F.when(change["type"] == "add", F.lit("Add")).when(change["type"] == "delete", F.lit("Delete")).otherwise(F.lit("Update"))
        body = F.when(change["content"] != "", F.concat(F.lit("\n"), change["content"])).otherwise(F.lit(""))
        return F.concat(F.lit("*** "), verb, F.lit(" File: "), path, F.coalesce(body, F.lit("")))

    strings = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    queries = strings(i("action")["queries"])
    results = F.coalesce(F.greatest(F.size(i("results")), F.lit(0)), F.lit(0))
    content = F.get_json_object(i("result"), "$.content")
    mcp_n = F.when(content.startswith("["), F.json_array_length(content)).when(i("result").startswith("{"), F.lit(1)).otherwise(F.lit(0))
    mcp_name = F.when((i("server") != "") & (i("tool") != ""), F.concat_ws(".", i("server"), i("tool"))).otherwise(F.coalesce(_filled(i("tool")), _filled(i("server")), F.lit("mcp")))
    dropped = lambda n: F.concat(n.cast("string"), F.lit(" result(s) dropped"))
    extension = F.coalesce(_filled(i("kind")), F.lit("extension"))
    pick = lambda **by: F.coalesce(*[F.when(kind == k, v) for k, v in by.items()])
    no = F.lit(False)
    return {
        "tool_name": pick(CommandExecution=F.lit("exec"), FileChange=F.lit("apply_patch"), Extension=extension, McpToolCall=mcp_name, CollabAgentToolCall=F.coalesce(_filled(i("tool")), F.lit("collab-agent")), ImageView=F.lit("view_image")),
        "raw_arguments": F.coalesce(pick(
            CommandExecution=argv, FileChange=F.array_join(F.transform(paths, patch), "\n"), Extension=F.when(F.size(queries) > 0, F.array_join(queries, "\n")).otherwise(F.coalesce(i("query"), F.lit(""))),
            McpToolCall=F.coalesce(i("arguments"), F.lit("")), CollabAgentToolCall=F.array_join(F.concat(strings(i("receiver_agents")), strings(i("receiver_thread_ids"))), "\n"), ImageView=F.coalesce(i("path"), F.lit("")),
        ), F.lit("")),
        "stated": pick(
            FileChange=F.concat(F.size(paths).cast("string"), F.lit(" file(s) changed")), Extension=dropped(results),
            McpToolCall=F.concat(F.coalesce(F.concat(_filled(i("status")), F.lit(", ")), F.lit("")), dropped(mcp_n)), CollabAgentToolCall=F.coalesce(_filled(i("status")), F.lit("no status recorded")), ImageView=F.lit("image not carried"),
        ),
        "output": F.when(kind == "CommandExecution", F.coalesce(i("aggregated_output"), i("formatted_output"), i("stdout"))),
        "item_effect": pick(CommandExecution=F.lit("unknown"), FileChange=F.lit("mutating"), Extension=F.when(extension == "web.search", F.lit("read-only")).otherwise(F.lit("unknown")), McpToolCall=F.lit("unknown"), CollabAgentToolCall=F.lit("unknown"), ImageView=F.lit("read-only")),
        "item_dropped": pick(FileChange=no, Extension=F.lit(True), McpToolCall=i("result").isNotNull(), CollabAgentToolCall=F.size(_keys(i("agents_states"))) > 0, ImageView=no),
        "item_paths": F.when(kind == "FileChange", paths),
    }


def patched_paths(arguments: Column) -> Column:
    """Paths of a call's arguments: named fields first, then the file headers of a patch."""
    named = F.array(*[_filled(F.get_json_object(arguments, f"$.{k}")) for k in ("path", "file_path", "filename")])
    values = F.array_join(F.map_values(F.from_json(arguments, "map<string, string>")), "\n")
    text = F.when(F.ltrim(arguments).startswith("{"), F.coalesce(values, arguments)).otherwise(arguments)
    headers = F.transform(F.regexp_extract_all(text, F.lit(r"\*\*\* (?:Add|Update|Delete) File: ([^\n]+)"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(F.concat(named, headers), lambda x: x.isNotNull() & (x != ""))


def turns(rows: DataFrame) -> DataFrame:
    """Canonical turns of classified entries, with changed_paths of each call."""
    outputs = rows.where(F.col("p.type").isin("function_call_output", "custom_tool_call_output") & (F.col("type") == "response_item") & F.col("p.call_id").isNotNull())
    output_text = F.when(F.col("p.output").startswith("["), F.array_join(F.transform(F.from_json("p.output", "array<struct<text: string>>"), lambda x: F.coalesce(x.text, F.lit(""))), "\n")).otherwise(F.coalesce("p.output", F.lit("")))
    answers = last_results(outputs.select(*SESSION, F.col("p.call_id").alias("call_id"), "pos", output_text.alias("answer")))
    kept = in_scope(rows).where(F.col("class").isin("message", "item-message", "summary", "call", "item-call"))
    kept = kept.withColumn("call_id", F.when(F.col("class") == "call", F.col("p.call_id")))
    kept = kept.join(answers, [*SESSION, "call_id"], "left").withColumns(_item_record())
    is_call, is_item = F.col("class") == "call", F.col("class") == "item-call"
    older = F.when(F.col("p.type") == "function_call", F.col("p.arguments")).otherwise(F.col("p.input"))
    kept = kept.withColumns({
        "tool_name": F.when(is_call, F.col("p.name")).when(is_item, F.col("tool_name")),
        "raw_arguments": F.when(is_call, F.coalesce(older, F.lit(""))).when(is_item, F.col("raw_arguments")),
        "output": F.when(is_call, F.col("answer")).otherwise(F.col("output")),
    })
    kept = redacted(kept, "text").withColumn("arguments_text", redact_arguments(F.col("raw_arguments")))
    head = _head(F.col("tool_name"), F.col("arguments_text"))
    line, dropped = outcome_codex(head, F.col("output"))
    outcome = F.when(F.col("stated").isNotNull() & is_item, redact_text(F.concat(head, F.lit(" → "), "stated"))).otherwise(line)
    effect = F.when(is_item, F.col("item_effect")).otherwise(effect_of(F.col("tool_name"), "codex"))
    recorded = F.when(is_call, F.col("answer").isNotNull()).when(is_item, F.col("stated").isNotNull() | F.col("output").isNotNull())
    order = Window.partitionBy(*SESSION).orderBy("pos")
    tool = is_call | is_item
    return kept.select(
        *SESSION, (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.when(tool | (F.col("class") == "summary"), F.lit("agent")).otherwise(F.col("role")).alias("role"),
        F.when(tool, F.lit("tool-call")).when(F.col("class") == "summary", F.lit("summary")).otherwise(F.lit("message")).alias("kind"),
        F.when(tool, F.lit("")).otherwise(F.col("text")).alias("text"), "tool_name", "arguments_text",
        F.when(tool, outcome).alias("outcome_line"), F.when(tool, effect).alias("effect"),
        F.when(tool, F.coalesce("item_dropped", dropped)).alias("body_dropped"), recorded.alias("result_recorded"), F.col("stamp").alias("ts"),
        F.when(is_call & (effect == "mutating"), patched_paths(F.col("raw_arguments"))).when(is_item, F.coalesce("item_paths", F.array().cast("array<string>"))).alias("changed_paths"),
    )


def catalog(rows: DataFrame) -> DataFrame:
    """One row per file with session meta, from one aggregate over the classified entries; and what was skipped."""
    scoped = in_scope(rows)
    is_turn = F.col("class").isin("message", "item-message", "summary", "call", "item-call")
    counted = scoped.groupBy(*SESSION).agg(F.count_if(is_turn).alias("turn_count"))
    meta = F.when((F.col("type") == "session_meta") & (F.coalesce("p.id", "p.session_id") != ""), F.col("pos"))
    facts = rows.groupBy(*SESSION, "file").agg(
        F.min_by(F.struct(F.coalesce("p.id", "p.session_id").alias("id"), F.coalesce("p.timestamp", "raw_stamp").alias("stamp"), F.col("p.cwd").alias("cwd"), F.col("p.git.commit_hash").alias("commit"), F.col("p.git.branch").alias("branch")), meta).alias("meta"),
        F.min_by("stamp", F.when(F.col("class") != "cut", F.col("pos"))).alias("first_stamp"),
        F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("pos"))).alias("last_stamp"),
        F.min_by("text", F.when((F.col("role") == "user") & F.col("class").isin("message", "item-message"), F.col("pos"))).alias("request"),
        F.count_if(F.col("class") == "unknown").alias("skipped"),
        F.array_sort(F.collect_set(F.when(F.col("class") == "unknown", F.concat_ws("/", "type", "p.type")))).alias("skipped_types"), F.bool_or("cut_line").alias("truncated"),
    )
    started = F.coalesce(parsed_iso(F.col("meta.stamp")), "first_stamp")
    where = F.when(is_absolute(F.col("meta.cwd")), F.col("meta.cwd"))
    return facts.join(counted, SESSION, "left").select(
        *SESSION, "file", F.col("meta.id").alias("recorded_id"), cut_within(first_visible_line(redact_text(F.coalesce("request", F.lit("")))), 80).alias("title"),
        F.coalesce(started, F.lit("")).alias("started_at"), F.coalesce("last_stamp", started, F.lit("")).alias("updated_at"), F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        where.alias("repo_path"), where.alias("start_directory"), F.col("meta.commit").alias("commit"), F.col("meta.branch").alias("branch"), "skipped", "skipped_types", "truncated",
    ).where("recorded_id is not null")
