"""Project transcripts: entries with uuid and parentUuid, whose live branch ends at the last entry.

A line that is no JSON object makes the whole file unreadable: no turns, but directory and branch of what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.redact import redacted, render_arguments
from turnloom.functions.text import cut_after, first_line, is_absolute, parsed_iso, wide_trim
from turnloom.operators.branch import active_path, off_path
from turnloom.operators.catalog import distinct_in_order, first_known
from turnloom.operators.pairing import effect_of, last_results, outcome_claude
from turnloom.session import written
from turnloom.sources.lines import checked, is_blank

SESSION = ["agent", "home", "session_id"]
UNTITLED, UNREADABLE = "(no user message)", "(unreadable session file)"
_ENTRY = "type string, uuid string, parentUuid string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, cwd string, gitBranch string, timestamp string, summary string, message string, toolUseResult string"
_BLOCK = "type: string, text: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean"
# User entries that carry local commands and their output.
_CARRIERS = (
    r"(?:^|\n)<local-command-stdout>[\s\S]*</local-command-stdout>(?:\n|$)",
    r"(?:^|\n)<local-command-caveat>[\s\S]*</local-command-caveat>(?:\n|$)",
    r"^<command-(?:name|message|args)>[\s\S]*</command-(?:name|message|args)>",
    r"^<bash-input>[\s\S]*</bash-input>(?:\n|$)",
    r"^<bash-std(?:out|err)>[\s\S]*</bash-std(?:out|err)>(?:\n|$)",
)
_PATHS = ("file_path", "notebook_path", "path", "filePath")


def is_carrier(text: Column) -> Column:
    """Whether a user text is a local command, its input or its output."""
    x = wide_trim(text)
    found = F.lit(False)
    for pattern in _CARRIERS:
        found = found | x.rlike(pattern)
    return found


def visible(blocks: Column) -> Column:
    """The text blocks, joined by line feeds."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries before any bad line (with `broken` if the file has one), and rejects of broken files."""
    rows = checked(lines)
    first_bad = F.min(F.when(~F.col("good"), F.col("pos"))).over(Window.partitionBy(*SESSION))
    rows = rows.withColumn("bad", first_bad).where(F.col("bad").isNull() | (F.col("pos") < F.col("bad")))
    parsed = rows.select(*SESSION, "file", "file_time", "pos", F.col("bad").isNotNull().alias("broken"), F.from_json("value", _ENTRY).alias("e"))
    message = F.col("e.message")
    plain = F.from_json(message, "content string")["content"]
    blocks = F.from_json(message, f"content array<struct<{_BLOCK}, content: string>>")["content"]
    inner = F.from_json(message, "content array<struct<content: array<struct<text: string>>>>")["content"]
    out = parsed.select(
        *SESSION, "file", "file_time", "pos", "broken", F.col("e.type").alias("type"), F.col("e.uuid").alias("id"), F.col("e.parentUuid").alias("parent"),
        F.coalesce("e.isSidechain", F.lit(False)).alias("side"), F.coalesce("e.isMeta", F.lit(False)).alias("meta"), F.coalesce("e.isCompactSummary", F.lit(False)).alias("compact"),
        F.col("e.cwd").alias("cwd"), F.col("e.gitBranch").alias("branch"), parsed_iso(F.col("e.timestamp")).alias("stamp"), F.col("e.summary").alias("summary"),
        F.coalesce(F.col("e.toolUseResult").startswith("{"), F.lit(False)).alias("structured"),
        F.when(blocks.isNull(), plain).alias("plain"), blocks.alias("blocks"), inner.alias("inner"),
    )
    broken = checked(lines).where(~F.col("good")).select(*SESSION).distinct()
    return out, broken.withColumn("reason", F.lit("a line is not a JSON object"))


def paths(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live path as of active_path(), entries that it leaves out as of off_path()) of the files' lines."""
    rows = written(entries(lines)[0], "claude-entries")
    path, _ = active_path(rows.where(~F.col("broken") & ~F.col("side") & F.col("id").isNotNull()))
    return path, off_path(rows, path)


def turns(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, catalog, rejects) of the files' lines."""
    rows, broken = entries(lines)
    rows = written(rows, "claude-entries")
    chain = rows.where(~F.col("broken") & ~F.col("side") & F.col("id").isNotNull())
    path, wrong = active_path(chain)
    rejects = broken.unionByName(wrong)
    active = written(rows.join(path, [*SESSION, "pos"]), "claude-active")

    results = active.where(F.col("type") == "user").select(*SESSION, "depth", "structured", F.posexplode(F.arrays_zip("blocks", "inner")).alias("n", "z"))
    result = F.col("z.blocks")
    listed = F.col("z.inner.content")
    texts = F.filter(F.transform(listed, lambda x: x["text"]), lambda t: t.isNotNull())
    body = F.when(listed.isNull(), F.when(~F.coalesce(result["content"].startswith("{"), F.lit(False)), result["content"])).when(F.size(texts) > 0, F.array_join(texts, "\n"))
    present = F.when(listed.isNotNull(), F.size(listed) > 0).otherwise(F.coalesce(result["content"] != "", F.lit(False))) | F.col("structured")
    answers = results.where((result["type"] == "tool_result") & result["tool_use_id"].isNotNull()).select(
        *SESSION, result["tool_use_id"].alias("call_id"), F.struct("depth", "n").alias("pos"), body.alias("body"), present.alias("present"), F.coalesce(result["is_error"], F.lit(False)).alias("error"),
    )
    answers = last_results(answers).withColumn("recorded", F.lit(True))

    said = F.coalesce(F.col("plain"), visible(F.col("blocks")), F.lit(""))
    whole = active.withColumn("said", said)
    user = (F.col("type") == "user") & ~F.col("meta") & ~is_carrier(F.col("said")) & ~is_blank(F.col("said")) & ~F.col("compact")
    compact = (F.col("type") == "user") & F.col("compact") & ~is_blank(F.col("said"))
    noted = (F.col("type") == "summary") & F.col("summary").isNotNull()
    talk = (F.col("type") == "assistant") & F.col("plain").isNotNull()
    single = whole.where(user | compact | noted | talk).select(
        *SESSION, "depth", F.lit(0).alias("n"), "stamp",
        F.when(user, F.lit("user")).otherwise(F.lit("agent")).alias("role"), F.when(user | talk, F.lit("message")).otherwise(F.lit("summary")).alias("kind"),
        F.when(noted, F.col("summary")).otherwise(F.col("said")).alias("text"),
    )
    # Blocks of one entry: text between two calls is one turn, numbered by the calls before it.
    blocks = active.where((F.col("type") == "assistant") & F.col("blocks").isNotNull()).select(*SESSION, "depth", "stamp", F.posexplode("blocks").alias("n", "b"))
    is_use = F.coalesce(F.col("b.type") == "tool_use", F.lit(False))
    order = Window.partitionBy(*SESSION).orderBy("depth", "n")
    blocks = blocks.withColumns({"use": is_use, "run": F.sum(is_use.cast("int")).over(order)})
    texts = blocks.where((F.col("b.type") == "text") & F.col("b.text").isNotNull()).groupBy(*SESSION, "depth", "run").agg(
        F.min("n").alias("n"), F.first("stamp").alias("stamp"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("b.text").alias("t")))), lambda x: x.t), "\n").alias("text"),
    ).select(*SESSION, "depth", "n", "stamp", F.lit("agent").alias("role"), F.lit("message").alias("kind"), "text")
    calls = blocks.where("use").select(
        *SESSION, "depth", "n", "stamp", F.lit("agent").alias("role"), F.lit("tool-call").alias("kind"), F.lit("").alias("text"),
        F.coalesce("b.name", F.lit("unknown-tool")).alias("tool_name"), F.col("b.id").alias("call_id"), F.col("b.input").alias("input"),
    )
    everything = single.unionByName(texts).unionByName(calls, allowMissingColumns=True)
    joined = redacted(everything, "text").join(answers, [*SESSION, "call_id"], "left").withColumn("arguments_text", F.when(F.col("tool_name").isNotNull(), render_arguments(F.col("input"))))
    tool = F.col("tool_name").isNotNull()
    recorded = F.coalesce("recorded", F.lit(False))
    line, dropped = outcome_claude(F.concat("tool_name", F.lit("("), "arguments_text", F.lit(")")), F.col("body"), F.coalesce("present", F.lit(False)), F.coalesce("error", F.lit(False)), recorded)
    effect = effect_of(F.col("tool_name"), "claude-code")
    path_of = F.coalesce(*[F.get_json_object("input", f"$.{k}") for k in _PATHS])
    out = joined.select(
        *SESSION, (F.row_number().over(order) - 1).cast("long").alias("idx"), "role", "kind", "text", "tool_name", "arguments_text",
        F.when(tool, line).alias("outcome_line"), effect.alias("effect"), F.when(tool, dropped).alias("body_dropped"), F.when(tool, recorded).alias("result_recorded"),
        F.col("stamp").alias("ts"), F.when(effect == "mutating", F.array_compact(F.array(path_of))).alias("changed_paths"),
    )

    # Facts come from the live branch; of broken files from all entries before the cut.
    on_path = active.select(*SESSION, "pos", F.col("depth").alias("at"))
    seen = rows.join(on_path, [*SESSION, "pos"], "left").where(~F.col("side"))
    at = F.when(F.col("broken"), F.col("pos")).otherwise(F.col("at"))
    facts = seen.groupBy(*SESSION).agg(
        distinct_in_order(F.when(at.isNotNull() & is_absolute(F.col("cwd")), F.col("cwd")), at).alias("repo_paths"),
        first_known(F.when(at.isNotNull(), F.col("branch")), at).alias("branch"),
        first_known(F.when(is_absolute(F.col("cwd")), F.col("cwd")), F.col("pos")).alias("start_directory"),
    )
    files = lines.groupBy(*SESSION).agg(F.min("file").alias("file"), F.max("file_time").alias("file_time"))
    first = F.min_by("text", F.when((F.col("role") == "user") & (F.col("kind") == "message"), F.col("idx")))
    spoken = out.groupBy(*SESSION).agg(first.alias("request"), first_known(F.col("ts"), F.col("idx")).alias("started"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("idx"))).alias("updated"), F.count("*").alias("n"))
    lost = rejects.select(*SESSION).distinct().withColumn("lost", F.lit(True))
    table = files.join(facts, SESSION, "left").join(spoken, SESSION, "left").join(lost, SESSION, "left")
    title = cut_after(first_line(F.col("request")), 80)
    gone = F.coalesce("lost", F.lit(False))
    catalog = table.select(
        *SESSION, "file", F.when(gone, F.lit(UNREADABLE)).when(F.coalesce(title, F.lit("")) == "", F.lit(UNTITLED)).otherwise(title).alias("title"),
        F.when(gone, F.col("file_time")).otherwise(F.coalesce("started", "file_time")).alias("started_at"), F.when(gone, F.col("file_time")).otherwise(F.coalesce("updated", "file_time")).alias("updated_at"),
        F.when(gone, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).alias("turn_count"), F.get("repo_paths", F.lit(0)).alias("repo_path"), "repo_paths", "start_directory", "branch",
    )
    return out, catalog, rejects
