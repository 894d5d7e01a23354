"""Which turns of a session cross over into a target's window, as windows over the turns.

plan_turns() takes a session's turns in one window each. plan_long_turns() gives the same rows for sessions of any length:
they are cut into ranges of idx, windows run within ranges, and what a range needs of the others (the last answered turn, the
first request, how many turns and how much cost lie before or behind) is summed up over the ranges, one row for each.
plan_any_turns() sends only sessions of more than RANGE turns that way.

turns has S = (agent, home, session_id), idx, role, kind, text, tool_name, arguments_text, outcome_line, effect,
body_dropped, result_recorded. One shuffle on the session and target serves every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import joined_lines
from turnloom.functions.tokens import budget, turn_cost
from turnloom.session import written

SESSION = ["agent", "home", "session_id"]
# Sentences that reports must carry word for word.
BODY_DROPPED = "(content dropped: imported session, may be stale)"
NO_OUTCOME = "(outcome not recorded by the source)"
ADVICE = "Raise budgetShare, lower pinnedRecentTurns, or choose a target with a larger window."
BLOCKED_BY_BUDGET = f"nothing to import — the budget removed all turns. {ADVICE}"
BLOCKED_EMPTY = "nothing to import — the session has no importable content. Choose a different session."


def normal_outcome() -> Column:
    """One line; a sentence where none is recorded; the dropped body named at the end, once."""
    line = joined_lines(F.coalesce("outcome_line", F.lit("")))
    stated = F.when(line == "", F.lit(NO_OUTCOME)).otherwise(line)
    marked = F.coalesce("body_dropped", F.lit(False)) & ~stated.endswith(BODY_DROPPED)
    return F.when(marked, F.concat(stated, F.lit(f" {BODY_DROPPED}"))).otherwise(stated)


def unanswered() -> Column:
    """A call whose record is missing or says that no result was recorded; an unknown flag counts as recorded."""
    return (F.col("kind") == "tool-call") & (F.col("tool_name").isNull() | F.coalesce(~F.col("result_recorded"), F.lit(False)))


def targeted(turns: DataFrame, targets: DataFrame | None, window_tokens: int | None) -> DataFrame:
    """Turns with the window of each target; `targets` has target and window_tokens, a few rows that fit a literal."""
    if targets is None:
        return turns.withColumns({"target": F.lit("default"), "window_tokens": F.lit(window_tokens).cast("long")})
    rows = targets.select("target", F.col("window_tokens").cast("long").alias("window_tokens")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1000 targets can be planned at once")
    each = F.array(*[F.struct(F.lit(r[0]).alias("target"), F.lit(r[1]).cast("long").alias("window_tokens")) for r in rows])
    return turns.select("*", F.explode(each).alias("_t")).select("*", "_t.*").drop("_t")


#: Turns of a session that one task handles together in plan_long_turns().
RANGE = 65_536


def _reasons(inside: Column, first: Column, recent: Column) -> Column:
    reasons = F.array_compact(F.array(
        F.when(F.col("idx") == first, F.lit("first-request")), F.when(recent, F.lit("recent-turn")),
        F.when(F.col("kind") == "summary", F.lit("summary")), F.when(F.col("effect") == "mutating", F.lit("changed-files")),
    ))
    return F.when(inside, reasons).otherwise(F.array().cast("array<string>"))


def plan_turns(turns: DataFrame, window_tokens: int | None = 200_000, targets: DataFrame | None = None, budget_share: float = 0.3, pinned_recent: int = 5, family: str = "generic") -> DataFrame:
    """Every turn with cost, pin_reasons, drop_reason ('broken-tail', 'budget' or null) and the plan's totals beside it.

    Dropping the oldest unpinned turns until the rest fits is a condition on running sums: an unpinned turn goes exactly
    if the pinned turns fit and the total without the unpinned turns before it is still above the budget.
    """
    whole = Window.partitionBy(*SESSION, "target")
    ordered = whole.orderBy("idx")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = targeted(turns, targets, window_tokens)
    rows = rows.withColumn("outcome_line", F.when(F.col("tool_name").isNotNull(), normal_outcome()))
    rows = rows.withColumns({"cost": turn_cost(family), "_open": unanswered()})
    rows = rows.withColumn("_upto", F.coalesce(F.max(F.when(~F.col("_open"), F.col("idx"))).over(whole), F.lit(-1)))
    inside = F.col("idx") <= F.col("_upto")
    request = (F.col("role") == "user") & (F.col("kind") == "message") & inside
    rows = rows.withColumns({
        "_first": F.min(F.when(request, F.col("idx"))).over(whole),
        "_size": F.count_if(inside).over(whole),
        "_place": F.row_number().over(ordered),
    })
    recent = F.col("_place") > F.col("_size") - max(0, int(pinned_recent))
    rows = rows.withColumn("pin_reasons", _reasons(inside, F.col("_first"), recent))
    pinned = F.size("pin_reasons") > 0
    free_cost = F.when(inside & ~pinned, F.col("cost")).otherwise(0)
    rows = rows.withColumns({
        "budget_tokens": budget(budget_share, F.col("window_tokens")),
        "total_cost": F.sum(F.when(inside, F.col("cost")).otherwise(0)).over(whole),
        "pinned_cost": F.sum(F.when(pinned, F.col("cost")).otherwise(0)).over(whole),
        "_freed": F.coalesce(F.sum(free_cost).over(before), F.lit(0)),
    })
    goes = inside & ~pinned & (F.col("pinned_cost") <= F.col("budget_tokens")) & (F.col("total_cost") - F.col("_freed") > F.col("budget_tokens"))
    reason = F.when(~inside, F.lit("broken-tail")).when(goes, F.lit("budget"))
    return rows.withColumn("drop_reason", reason).drop("_open", "_upto", "_first", "_size", "_place", "_freed")


def _spread(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with what is known of their range; keys are structs, so that null homes meet too."""
    return rows.join(sums.withColumnsRenamed({"_session": "_of", "_range": "_at"}), (F.col("_session") == F.col("_of")) & (F.col("_range") == F.col("_at"))).drop("_of", "_at")


def plan_long_turns(turns: DataFrame, window_tokens: int | None = 200_000, targets: DataFrame | None = None, budget_share: float = 0.3, pinned_recent: int = 5, family: str = "generic", range_rows: int = RANGE) -> DataFrame:
    """The rows of plan_turns(), with no more than range_rows turns of a session in one window (idx must not repeat)."""
    session = Window.partitionBy("_session")
    earlier = session.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = session.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    part = Window.partitionBy("_session", "_range")
    in_part = part.orderBy("idx")
    zero = lambda x: F.coalesce(x, F.lit(0))

    rows = turns.withColumn("outcome_line", F.when(F.col("tool_name").isNotNull(), normal_outcome()))
    rows = rows.withColumns({"cost": turn_cost(family), "_open": unanswered(), "_session": F.struct(*SESSION), "_range": F.floor(F.col("idx") / range_rows)})
    rows = rows.withColumn("_last", F.max(F.when(~F.col("_open"), F.col("idx"))).over(part))
    asked = (F.col("role") == "user") & (F.col("kind") == "message")
    found = rows.groupBy("_session", "_range").agg(
        F.max("_last").alias("_last_here"), F.count("*").alias("_n"), F.count_if(F.col("idx") <= F.col("_last")).alias("_n_upto"), F.min(F.when(asked, F.col("idx"))).alias("_asked"),
    )
    found = found.withColumns({"_upto": F.coalesce(F.max("_last_here").over(session), F.lit(-1)), "_first": F.min("_asked").over(session)})
    here = F.floor(F.col("_upto") / range_rows)
    inside_here = F.when(F.col("_range") < here, F.col("_n")).when(F.col("_range") == here, F.col("_n_upto")).otherwise(0)
    found = found.withColumn("_inside", inside_here).withColumn("_behind", zero(F.sum("_inside").over(later)))
    rows = _spread(rows, found.select("_session", "_range", "_upto", "_first", "_inside", "_behind"))

    inside = F.col("idx") <= F.col("_upto")
    recent = F.col("_inside") - F.row_number().over(in_part) + F.col("_behind") < max(0, int(pinned_recent))
    rows = rows.withColumn("pin_reasons", _reasons(inside, F.when(F.col("_first") <= F.col("_upto"), F.col("_first")), recent))
    pinned = F.size("pin_reasons") > 0
    rows = rows.withColumn("_free", F.when(inside & ~pinned, F.col("cost")).otherwise(0))
    sums = rows.groupBy("_session", "_range").agg(F.sum("_free").alias("_free_here"), F.sum(F.when(inside, F.col("cost")).otherwise(0)).alias("_cost_here"), F.sum(F.when(pinned, F.col("cost")).otherwise(0)).alias("_pinned_here"))
    sums = sums.select(
        "_session", "_range", zero(F.sum("_free_here").over(earlier)).alias("_freed_before"), F.sum("_cost_here").over(session).alias("total_cost"), F.sum("_pinned_here").over(session).alias("pinned_cost"),
    )
    rows = _spread(rows, sums)
    freed = F.col("_freed_before") + zero(F.sum("_free").over(in_part.rowsBetween(Window.unboundedPreceding, -1)))
    # Targets differ in their budget alone, so turns are multiplied only at the end.
    rows = targeted(rows.withColumns({"_freed": freed, "_in": inside}), targets, window_tokens).withColumn("budget_tokens", budget(budget_share, F.col("window_tokens")))
    goes = F.col("_in") & ~pinned & (F.col("pinned_cost") <= F.col("budget_tokens")) & (F.col("total_cost") - F.col("_freed") > F.col("budget_tokens"))
    rows = rows.withColumn("drop_reason", F.when(~F.col("_in"), F.lit("broken-tail")).when(goes, F.lit("budget")))
    return rows.select(
        *turns.columns, "target", "window_tokens", "cost", "pin_reasons", "budget_tokens", "total_cost", "pinned_cost", "drop_reason",
    )


def plan_any_turns(turns: DataFrame, *args, range_rows: int = RANGE, **kind) -> DataFrame:
    """plan_turns(), with sessions of more than range_rows turns through plan_long_turns(); turns are read twice."""
    keys = [F.col(c).alias(f"_{c}") for c in SESSION]
    long = written(turns.groupBy(*SESSION).agg(F.count("*").alias("n")).where(F.col("n") > range_rows).select(*keys), "long-sessions")
    if not long.limit(1).count():
        return plan_turns(turns, *args, **kind)
    same = F.lit(True)
    for c in SESSION:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    short = plan_turns(turns.join(long, same, "left_anti"), *args, **kind)
    return short.unionByName(plan_long_turns(turns.join(long, same, "left_semi"), *args, range_rows=range_rows, **kind))


def plans(planned: DataFrame, budget_share: float = 0.3) -> DataFrame:
    """One row per session and target: counts, tokens, and why the plan is blocked if it is."""
    kept = F.col("drop_reason").isNull()
    rows = planned.groupBy(*SESSION, "target").agg(
        F.first("window_tokens").alias("window_tokens"),
        F.first("budget_tokens").alias("budget_tokens"),
        F.count_if(kept).alias("kept_turns"),
        F.count_if(~kept).alias("dropped_turns"),
        F.count_if(F.col("drop_reason") == "budget").alias("budget_drops"),
        F.count_if(F.col("drop_reason") == "broken-tail").alias("tail_drops"),
        F.count_if(F.coalesce("body_dropped", F.lit(False)) & F.coalesce(F.col("drop_reason") != "broken-tail", F.lit(True))).alias("bodies_dropped"),
        F.sum(F.when(kept, F.col("cost")).otherwise(0)).alias("estimated_tokens"),
        F.first("pinned_cost").alias("pinned_tokens"),
    )
    share = F.lit(f"{budget_share:g}")
    over = F.concat(
        F.lit("Pinned content needs "), F.col("pinned_tokens").cast("string"), F.lit(" tokens but the budget is "), F.col("budget_tokens").cast("string"),
        F.lit(" tokens (budgetShare "), share, F.lit(" of a "), F.col("window_tokens").cast("string"), F.lit(f"-token window). {ADVICE}"),
    )
    blocked = F.when(F.col("pinned_tokens") > F.col("budget_tokens"), over).when((F.col("kept_turns") == 0) & (F.col("budget_drops") > 0), F.lit(BLOCKED_BY_BUDGET)).when(F.col("kept_turns") == 0, F.lit(BLOCKED_EMPTY))
    return rows.withColumn("blocked_reason", blocked)


def pin_report(planned: DataFrame) -> DataFrame:
    """One row per pin: idx and reason, several for a turn with several reasons."""
    return planned.select(*SESSION, "target", "idx", F.posexplode("pin_reasons").alias("reason_order", "reason"))


def window_of(capabilities: DataFrame, overrides: DataFrame) -> DataFrame:
    """agent and window_tokens: the override if there is one, else the declared window."""
    over = overrides.select(F.col("agent").alias("of"), F.col("window_tokens").alias("override"))
    return capabilities.join(over, F.col("agent") == F.col("of"), "left").select("agent", F.coalesce("override", "window_tokens").alias("window_tokens"))
