"""Plans against a plain loop, reports word for word, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.plans import report, transfer
from turnloom.sources.tables import with_turn_columns

SHAPE = "agent string, home string, session_id string, idx long, role string, kind string, text string, tool_name string, arguments_text string, outcome_line string, effect string, body_dropped boolean, result_recorded boolean, ts string"


def estimate(text):
    return -(-len(text.encode()) // 4) + sum(ord(c) > 0xFFFF for c in text)


def turn(session, idx, rng):
    kind = rng.choice(["message"] * 4 + ["tool-call"] * 5 + ["summary"])
    if kind == "tool-call":
        return ("a", "h", session, idx, "agent", kind, "", "Edit", "x" * rng.randint(0, 40), rng.choice(["", " two\n lines ", "done"]), rng.choice(["mutating", "read-only", "unknown"]), rng.random() < 0.5, rng.choice([True, False, None]), None)
    return ("a", "h", session, idx, rng.choice(["user", "agent"]) if kind == "message" else "agent", kind, rng.choice(["é😀", "plain "]) * rng.randint(1, 30), *[None] * 7)


def loop(turns, window, share, recent):
    """The rules as a walk over one session."""
    cut = len(turns)
    while cut and turns[cut - 1][5] == "tool-call" and (turns[cut - 1][7] is None or turns[cut - 1][12] is False):
        cut -= 1
    rows = turns[:cut]
    drops = {t[3]: "broken-tail" for t in turns[cut:]}
    costs = []
    for t in rows:
        text = t[6]
        if t[7] is not None:
            line = " ".join(x.strip() for x in (t[9] or "").split("\n") if x.strip()) or transfer.NO_OUTCOME
            line += f" {transfer.BODY_DROPPED}" if t[11] else ""
            text = f"{t[6]}\n{t[7]}\n{t[8]}\n{line}"
        costs.append(estimate(text) + 4)
    pins = {}
    for t in rows:
        if t[4] == "user" and t[5] == "message":
            pins.setdefault(t[3], []).append("first-request")
            break
    for t in rows[max(0, len(rows) - recent):] if recent > 0 else []:
        pins.setdefault(t[3], []).append("recent-turn")
    for t in rows:
        if t[5] == "summary":
            pins.setdefault(t[3], []).append("summary")
        if t[10] == "mutating":
            pins.setdefault(t[3], []).append("changed-files")
    budget, total = int(share * window), sum(costs)
    pinned = sum(c for t, c in zip(rows, costs) if t[3] in pins)
    if pinned <= budget:
        for t, c in zip(rows, costs):
            if total <= budget:
                break
            if t[3] not in pins:
                drops[t[3]] = "budget"
                total -= c
    return drops, pins, total, pinned > budget


@pytest.mark.parametrize(("window", "recent"), [(600, 3), (200, 0), (3000, 5), (90, 1)])
def test_closed_form_equals_loop(spark, window, recent):
    rng = random.Random(window)
    sessions = {f"s{n}": [turn(f"s{n}", i, rng) for i in range(rng.randint(1, 30))] for n in range(40)}
    frame = spark.createDataFrame([t for s in sessions.values() for t in s], SHAPE)
    planned = transfer.plan_turns(frame, window, budget_share=0.3, pinned_recent=recent)
    rows, totals = {}, {r.session_id: r for r in transfer.plans(planned).collect()}
    for r in planned.collect():
        rows.setdefault(r.session_id, []).append(r)
    for name, turns in sessions.items():
        drops, pins, total, blocked = loop(turns, window, 0.3, recent)
        assert {r.idx: r.drop_reason for r in rows[name] if r.drop_reason} == drops
        assert {r.idx: r.pin_reasons for r in rows[name] if r.pin_reasons} == pins
        t = totals[name]
        assert (t.estimated_tokens, t.kept_turns + t.dropped_turns) == (total, len(turns))
        assert blocked == (t.blocked_reason or "").startswith("Pinned content needs")
        assert t.blocked_reason or t.estimated_tokens <= t.budget_tokens


def test_known_session(spark):
    kinds = [("user", "message", None), ("agent", "message", None), ("agent", "tool-call", ("Read", "read-only", True)), ("agent", "tool-call", ("Grep", "read-only", True)), ("agent", "message", None), ("agent", "tool-call", ("Edit", "mutating", False)),
             ("agent", "tool-call", ("Write", "mutating", False)), ("agent", "tool-call", ("shell", "unknown", True)), ("agent", "summary", None), ("user", "message", None), ("agent", "message", None)]
    rows = [("codex", "/h", "id", i, role, kind, "" if tool else "text", tool and tool[0], tool and "a", tool and "o", tool and tool[1], tool and tool[2], tool and True, None) for i, (role, kind, tool) in enumerate(kinds)]
    planned = transfer.plan_turns(spark.createDataFrame(rows, SHAPE), 200_000, pinned_recent=5)
    pins = {}
    for r in transfer.pin_report(planned).collect():
        pins.setdefault(r.reason, set()).add(r.idx)
    assert pins == {"first-request": {0}, "recent-turn": {6, 7, 8, 9, 10}, "summary": {8}, "changed-files": {5, 6}}
    plan = transfer.plans(planned).first()
    assert (plan.bodies_dropped, plan.kept_turns, plan.dropped_turns, plan.tail_drops, plan.blocked_reason) == (3, 11, 0, 0, None)
    shown = report.preview(transfer.plans(planned), F.array(F.lit("head")), F.lit("/t")).first()
    assert shown.lines == ["head", "Target: default (/t)", "11 turns cross over", f"Budget: {plan.estimated_tokens} tokens of a 200k window", "3 tool result bodies dropped"]


def test_empty_and_tail_only(spark):
    rows = [("a", "h", "s", i, "agent", "tool-call", "", "Bash", "", "", "unknown", False, False, None) for i in range(3)]
    plan = transfer.plans(transfer.plan_turns(spark.createDataFrame(rows, SHAPE), 1000)).first()
    assert (plan.kept_turns, plan.tail_drops, plan.blocked_reason) == (0, 3, transfer.BLOCKED_EMPTY)
    assert transfer.plans(transfer.plan_turns(spark.createDataFrame([], SHAPE), 1000)).count() == 0


def test_long_session(spark):
    rows = spark.range(100_000).select(F.lit("a").alias("agent"), F.lit("h").alias("home"), F.lit("s").alias("session_id"), F.col("id").alias("idx"), F.lit("agent").alias("role"), F.lit("message").alias("kind"), F.lit("x" * 40).alias("text"))
    plan = transfer.plans(transfer.plan_turns(with_turn_columns(rows), 200_000)).first()
    assert plan.kept_turns + plan.dropped_turns == 100_000 and plan.estimated_tokens <= plan.budget_tokens < plan.estimated_tokens + 14


def test_drop_sentences(spark):
    shape = "dropped_turns long, bodies_dropped long, tail_drops long"
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 2, 2)], shape).select(report.drop_summary().alias("s")).collect()
    assert [r.s for r in rows] == [
        "Nothing was dropped: the whole session crossed over.", "Dropped on import: 1 turn.", "Dropped on import: 2 turns; 1 tool result body; an incomplete trailing tool call.",
        "Dropped on import: 3 turns; 2 tool result bodies; 2 incomplete trailing tool calls.",
    ]


def test_nothing_stored_is_written_again(spark):
    from turnloom.plans import export

    sessions = spark.createDataFrame([("a", "h", "1"), ("a", "h", "2")], "agent string, home string, session_id string")
    named = export.new_ids(sessions, "t")
    stored = named.where("session_id = '2'").select("new_id")
    assert [r.session_id for r in export.not_yet_stored(named, stored).collect()] == ["1"]
    assert sorted(r.new_id for r in named.collect()) == sorted(r.new_id for r in export.new_ids(sessions, "t").collect())


def test_stored_tables(spark, tmp_path):
    from turnloom.plans import store

    turns = spark.createDataFrame([("a", "h", "1", 0, "x"), ("b", "h", "1", 0, "y"), ("a", "h", "1", 1, "z")], "agent string, home string, session_id string, idx long, text string")
    store.write_tables(str(tmp_path / "s"), turns=turns, rejects=turns.limit(0))
    back = store.read_table(spark, str(tmp_path / "s"), "turns")
    assert sorted(map(tuple, back.select(turns.columns).collect())) == sorted(map(tuple, turns.collect()))
    assert "PartitionFilters: [isnotnull(agent" in back.where("agent = 'a'")._jdf.queryExecution().toString()


@pytest.mark.parametrize(("window", "recent", "range_rows"), [(600, 3, 1), (200, 0, 4), (3000, 5, 7), (90, 30, 3), (700, 2, 1000)])
def test_ranges_equal_windows(spark, window, recent, range_rows):
    rng = random.Random(window)
    rows = [turn(f"s{n}", i * rng.choice([1, 1, 3]) if n % 2 else i, rng) for n in range(40) for i in range(rng.randint(1, 40))]
    rows = list({(t[2], t[3]): t if n % 5 else (t[0], None, *t[2:]) for n, t in enumerate(rows)}.values())
    frame = spark.createDataFrame(rows, SHAPE)
    targets = spark.createDataFrame([("x", window), ("y", 2 * window)], "target string, window_tokens long")
    kind = {"targets": targets, "pinned_recent": recent}
    want = transfer.plan_turns(frame, **kind)
    columns = sorted(want.columns)
    key = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    want = key(want.select(columns).collect())
    assert key(transfer.plan_long_turns(frame, range_rows=range_rows, **kind).select(columns).collect()) == want
    assert key(transfer.plan_any_turns(frame, range_rows=range_rows, **kind).select(columns).collect()) == want


def test_one_long_session(spark):
    """A session of a million turns is planned in several tasks: no window holds more than a range of it."""
    n, cost = 1_000_000, 5
    turns = with_turn_columns(spark.range(n).select(F.lit("a").alias("agent"), F.lit("h").alias("home"), F.lit("one").alias("session_id"), F.col("id").alias("idx"), F.lit("user").alias("role"), F.lit("message").alias("kind"), F.lit("abc").alias("text")))
    rows = transfer.plan_any_turns(turns, 1_000_000, budget_share=1.0, pinned_recent=2)
    # 200,000 turns of 5 tokens fit: the first, and the last of the others.
    by_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("drop_reason") == "budget").alias("gone"), F.max(F.when(F.col("drop_reason") == "budget", F.col("idx"))).alias("last")).collect()
    assert sum(r.n for r in by_task) == n and sum(r.gone for r in by_task) == n - 1_000_000 // cost
    assert max(r.last for r in by_task) == n - 1_000_000 // cost and len([r for r in by_task if r.n > n / 20]) > 1
