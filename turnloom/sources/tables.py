"""Tables that are already parsed as canonical turns, one JSON document per session, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import iso_utc
from turnloom.sources.lines import is_blank

SESSION = ["agent", "home", "session_id"]
TURN = {
    "role": "string", "kind": "string", "text": "string", "tool_name": "string", "arguments_text": "string", "outcome_line": "string", "effect": "string",
    "body_dropped": "boolean", "result_recorded": "boolean", "ts": "string",
}


def with_turn_columns(rows: DataFrame) -> DataFrame:
    """rows with every column of a turn; absent ones are null."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in TURN.items() if c not in rows.columns})


def conversation_turns(conversations: DataFrame, agent: str = "table") -> DataFrame:
    """Turns of conversations (conv_id, turn, role, text): users and assistants speak, other roles and blank texts do not."""
    spoken = conversations.where(F.col("role").isin("user", "assistant") & ~is_blank(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("conv_id").orderBy("turn")
    return with_turn_columns(spoken.select(
        F.lit(agent).alias("agent"), F.lit("").alias("home"), F.col("conv_id").cast("string").alias("session_id"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"), F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("agent")).alias("role"),
        F.lit("message").alias("kind"), "text",
    ))


def event_turns(events: DataFrame, agent: str = "events") -> DataFrame:
    """Turns of a log of events (user_id, ts, event_id, event_type, props): each is one call; errors have no result."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    effect = F.when(F.col("event_type") == "view", F.lit("read-only")).when(F.col("event_type").isin("purchase", "signup"), F.lit("mutating")).otherwise(F.lit("unknown"))
    return with_turn_columns(events.select(
        F.lit(agent).alias("agent"), F.lit("").alias("home"), F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"), F.lit("agent").alias("role"), F.lit("tool-call").alias("kind"), F.lit("").alias("text"),
        F.col("event_type").alias("tool_name"), F.col("props").alias("arguments_text"), F.concat("event_type", F.lit(" done")).alias("outcome_line"), effect.alias("effect"),
        (F.col("event_type") == "view").alias("body_dropped"), (F.col("event_type") != "error").alias("result_recorded"), iso_utc(F.col("ts")).alias("ts"),
    ))


_DOCUMENT = (
    "kind string, id string, topic string, opened string, touched string, workspace string, vcs struct<commit: string, branch: string, touchedPaths: array<string>>, "
    "exchanges array<struct<stamp: string, speaker: string, shape: string, words: string, ran: struct<tool: string, args: string, outcome: string, impact: string>>>"
)


def document_turns(documents: DataFrame, agent: str = "document") -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of one JSON document per row (value). Fields that may hold bodies or secrets are never parsed."""
    d = documents.select(F.from_json("value", _DOCUMENT).alias("d")).where(F.col("d.id").isNotNull()).select("d.*")
    keys = [F.lit(agent).alias("agent"), F.coalesce("workspace", F.lit("")).alias("home"), F.col("id").alias("session_id")]
    each = d.select(*keys, F.posexplode("exchanges").alias("n", "x"))
    shape = F.col("x.shape")
    kind = F.when(shape == "ran", F.lit("tool-call")).when(shape == "recap", F.lit("summary")).otherwise(F.lit("message"))
    spoken = each.where((shape == "ran") | ~is_blank(F.coalesce("x.words", F.lit(""))))
    order = Window.partitionBy(*SESSION).orderBy("n")
    impact = F.when(F.col("x.ran.impact") == "reads", F.lit("read-only")).when(F.col("x.ran.impact") == "writes", F.lit("mutating")).otherwise(F.lit("unknown"))
    ran = shape == "ran"
    turns = with_turn_columns(spoken.select(
        *SESSION, (F.row_number().over(order) - 1).cast("long").alias("idx"), F.when(F.col("x.speaker") == "human", F.lit("user")).otherwise(F.lit("agent")).alias("role"), kind.alias("kind"),
        F.when(ran, F.lit("")).otherwise(F.col("x.words")).alias("text"), F.when(ran, F.col("x.ran.tool")).alias("tool_name"), F.when(ran, F.col("x.ran.args")).alias("arguments_text"),
        F.when(ran, F.col("x.ran.outcome")).alias("outcome_line"), F.when(ran, impact).alias("effect"), F.when(ran, F.lit(True)).alias("body_dropped"),
        F.when(ran, F.col("x.ran.outcome").isNotNull()).alias("result_recorded"), F.col("x.stamp").alias("ts"),
    ))
    sessions = d.select(*keys, F.col("topic").alias("title"), F.col("opened").alias("started_at"), F.col("touched").alias("updated_at"), F.col("vcs.commit").alias("commit"), F.col("vcs.branch").alias("branch"), F.array_distinct(F.filter("vcs.touchedPaths", lambda p: p != "")).alias("changed_paths"))
    return turns, sessions


_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_source(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a format: a function from its raw rows to canonical turns. Rules never look at the format's name."""
    _SOURCES[name] = reader


def read_source(name: str, raw: DataFrame) -> DataFrame:
    """The canonical turns of raw rows by a registered reader."""
    return with_turn_columns(_SOURCES[name](raw))


register_source("conversations", conversation_turns)
register_source("events", event_turns)
register_source("documents", lambda raw: document_turns(raw)[0])
