"""What a plan tells people: drop summaries, markers, preview lines, warnings, summaries and the context view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import commit_gap, counted, cut_after, cut_within, home_relative, printable_line, safe_line, same_commit, short_commit, thousands, to_minute

# Sentences of the reports.
NOTHING_DROPPED = "Nothing was dropped: the whole session crossed over."
NOT_KNOWN = "not known here"
OTHER_DIRECTORY = "⚠ The source session records a different directory. Conversation import does not transfer uncommitted work, switch branches, or recreate removed worktrees."
INCOMPLETE = "⚠ The last tool call was incomplete and was dropped."
WARNING_ORDER = ("repo-state", "budget", "broken-tail", "capability")


def drop_summary() -> Column:
    """One sentence naming what a plan removed, from the columns of plans()."""
    parts = F.concat_ws(
        "; ",
        F.when(F.col("dropped_turns") > 0, counted(F.col("dropped_turns"), "turn", "turns")),
        F.when(F.col("bodies_dropped") > 0, counted(F.col("bodies_dropped"), "tool result body", "tool result bodies")),
        F.when(F.col("tail_drops") == 1, F.lit("an incomplete trailing tool call")).when(F.col("tail_drops") > 1, F.concat(F.col("tail_drops").cast("string"), F.lit(" incomplete trailing tool calls"))),
    )
    return F.when(parts == "", F.lit(NOTHING_DROPPED)).otherwise(F.concat(F.lit("Dropped on import: "), parts, F.lit(".")))


def _directory(path: Column, home: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("(no recorded directory)")).otherwise(home_relative(path, home))


def marker_lines(agent: Column, session_id: Column, home: Column, imported_at: Column, directory: Column, branch: Column, user_home: Column) -> Column:
    """The three lines of the provenance marker, safe to store in a session file."""
    first = F.concat(F.lit("↻ Restored from "), safe_line(agent), F.lit(" "), safe_line(F.substring(session_id, 1, 8)), F.lit(" ("), safe_line(home_relative(home, user_home)), F.lit(") · "), to_minute(imported_at))
    second = F.concat(F.lit("  "), safe_line(_directory(directory, user_home)), F.lit(" · "), safe_line(F.coalesce(branch, F.lit("no branch"))))
    third = F.concat(counted(F.col("kept_turns"), "turn", "turns"), F.lit(" kept · "), drop_summary())
    return F.array(first, second, third)


def summary_lines(user_home: Column) -> Column:
    """The two lines that begin every listing of a session, from catalog columns and `place` of place()."""
    title = cut_within(safe_line(F.coalesce("title", F.lit(""))), 60)
    head = F.concat_ws(
        " · ",
        F.concat(F.lit("↻ "), F.col("agent"), F.lit(" "), F.substring("session_id", 1, 8)),
        home_relative(F.col("home"), user_home), to_minute(F.coalesce("updated_at", F.lit(""))), F.when(title == "", F.lit("(untitled)")).otherwise(title),
    )
    state = F.when(F.col("place") == "recoverable", F.lit("directory missing; it can be recreated")).when(F.col("place") == "unrecoverable", F.lit("directory missing and cannot be recovered"))
    return F.array(head, F.concat(F.lit("  "), F.concat_ws(" · ", _directory(F.col("directory"), user_home), F.coalesce("branch", F.lit("no branch")), state)))


def repository_warning(commit: Column, root: Column, head: Column, known: Column, ahead: Column, behind: Column) -> Column:
    """How the source's commit and the destination's head relate; null if they are the same."""
    ran = F.concat(F.lit("⚠ Source ran at "), short_commit(commit))
    now = F.concat(F.lit("The tree is now at "), short_commit(head))
    return (
        F.when(F.trim(F.coalesce(commit, F.lit(""))) == "", F.lit(f"⚠ The source session did not record a commit, so the repository state is {NOT_KNOWN}."))
        .when(root.isNull(), F.concat(ran, F.lit(f". This directory's repository identity is unresolved, so the repository state is {NOT_KNOWN}.")))
        .when(head.isNull(), F.concat(ran, F.lit(f". This repository has no commit yet, so the repository state is {NOT_KNOWN}.")))
        .when(same_commit(commit, head), F.lit(None).cast("string"))
        .when(~F.coalesce(known, F.lit(False)), F.concat(ran, F.lit(f", which is {NOT_KNOWN}. "), now, F.lit(".")))
        .otherwise(F.concat(ran, F.lit(". "), now, commit_gap(ahead, behind), F.lit(".")))
    )


def plan_warnings(repo_line: Column | None = None, other_directory: Column | None = None) -> Column:
    """Warnings (rank, kind, line) in their fixed order, from the columns of plans()."""
    text = F.lit(None).cast("string")
    over = F.concat(F.lit("⚠ The import is "), thousands(F.col("estimated_tokens")), F.lit(" tokens, over its "), thousands(F.col("budget_tokens")), F.lit(" budget."))
    lines = [
        ("repo-state", F.when(other_directory, F.lit(OTHER_DIRECTORY)) if other_directory is not None else text),
        ("repo-state", repo_line if repo_line is not None else text),
        ("budget", F.when(F.col("estimated_tokens") > F.col("budget_tokens"), over)),
        ("broken-tail", F.when(F.col("tail_drops") > 0, F.lit(INCOMPLETE))),
    ]
    each = F.array(*[F.when(line.isNotNull(), F.struct(F.lit(WARNING_ORDER.index(kind)).alias("rank"), F.lit(n).alias("seq"), F.lit(kind).alias("kind"), line.alias("line"))) for n, (kind, line) in enumerate(lines)])
    return F.array_sort(F.array_compact(each))


def preview(plans: DataFrame, summary: Column | None = None, target_home: Column | None = None, warnings: Column | None = None) -> DataFrame:
    """plans with budget_line, drop_lines and lines, the whole preview in order."""
    kept, dropped = F.col("kept_turns"), F.col("dropped_turns")
    crossing = F.when(kept == 0, F.lit("Nothing would cross over")).otherwise(F.concat(counted(kept, "turn crosses", "turns cross"), F.lit(" over")))
    count_line = F.when(dropped > 0, F.concat(crossing, F.lit(", "), dropped.cast("string"), F.lit(" dropped"))).otherwise(crossing)
    target = F.concat(F.lit("Target: "), F.col("target"), F.lit(" ("), cut_after(printable_line(target_home if target_home is not None else F.lit("")), 160), F.lit(")"))
    budget_line = F.concat(F.lit("Budget: "), thousands(F.col("estimated_tokens")), F.lit(" tokens of a "), thousands(F.col("window_tokens")), F.lit(" window"))
    drop_lines = F.array_compact(F.array(
        F.when(F.col("budget_drops") > 0, F.concat(counted(F.col("budget_drops"), "older turn", "older turns"), F.lit(" dropped"))),
        F.when(F.col("bodies_dropped") > 0, F.concat(counted(F.col("bodies_dropped"), "tool result body", "tool result bodies"), F.lit(" dropped"))),
    ))
    blocked = F.when(F.col("blocked_reason").isNotNull(), F.concat(F.lit("✖ The import cannot run: "), cut_after(printable_line(F.col("blocked_reason")), 200)))
    head = summary if summary is not None else F.array().cast("array<string>")
    rows = plans.withColumn("warnings", warnings if warnings is not None else plan_warnings())
    warned = F.transform("warnings", lambda w: w["line"])
    lines = F.concat(head, F.array(target, count_line, budget_line), warned, drop_lines, F.array_compact(F.array(blocked)))
    return rows.withColumns({"budget_line": budget_line, "drop_lines": drop_lines, "lines": lines})


def context_line() -> Column:
    """One turn as a line of the context view; a call's name and arguments come first unless its outcome names the call."""
    outcome = F.coalesce("outcome_line", F.lit(""))
    named = F.concat("tool_name", F.lit("("), F.coalesce("arguments_text", F.lit("")), F.lit(") → "), outcome)
    tool = F.when(F.contains(outcome, F.col("tool_name")), outcome).otherwise(named)
    return (
        F.when((F.col("kind") == "tool-call") & F.col("tool_name").isNotNull(), F.concat(F.lit("Tool: "), tool))
        .when(F.col("kind") == "summary", F.concat(F.lit("Summary: "), F.col("text")))
        .when(F.col("role") == "user", F.concat(F.lit("User: "), F.col("text")))
        .otherwise(F.concat(F.lit("Agent: "), F.col("text")))
    )
