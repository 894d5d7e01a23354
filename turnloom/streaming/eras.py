"""Rollouts of both eras as a stream: which of the older era's calls count, decided as lines come in.

The rule (sources.codex.in_scope): without an item turn all older calls count; with one, the calls before the first item
turn if a message of the older era stands before it too, else none. Lines of a session must come in the order of pos from
one batch to the next, as stream_growing_lines() gives them; within a batch any order will do.

running_catalog() keeps some numbers for each session, however long it is: its row is at any time that of the batch catalog
over the lines so far. settled_entries() passes entries on once it is known that they count. Only calls before the first
message and item turn have to wait; they are held in the state, and go out when a message of the older era comes, are dropped
when an item turn comes first, and count after all when the session ends: when an entry of class END comes for it, which
whoever knows that a session is over adds behind its last line.

Both need the RocksDB state store, which Spark's arbitrary stateful operators are built on; with_state_store() sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SESSION = ["agent", "home", "session_id"]
_KEYS = "agent string, home string, session_id string"
_TURNS = ("message", "item-message", "summary", "item-call")
_ITEMS = ("item-message", "item-call")
END = "end"
#: Numbers of the running catalog: first positions are -1 until there is one.
_FACTS = (
    "turns long, calls long, spoken boolean, cut long, first_pos long, first_stamp string, last_pos long, last_stamp string, asked_pos long, request string, truncated boolean"
)
CATALOG = f"{_KEYS}, request string, started_at string, updated_at string, turn_count long, mixed boolean, truncated boolean"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunningCatalog(StatefulProcessor):
    """Folds a session's entries into its catalog row."""

    columns = [*SESSION, "pos", "class", "role", "text", "stamp"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", _FACTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.facts.get() if self.facts.exists() else (0, 0, False, -1, -1, None, -1, None, -1, None, False)
        turns, calls, spoken, cut, first_pos, first_stamp, last_pos, last_stamp, asked_pos, request, truncated = old
        before = cut
        # Of the rows themselves only what the rule needs is kept until the batch's first item turn is known.
        said: list[pd.Series] = []
        called: list[pd.Series] = []
        for part in rows:
            part.columns = self.columns  # Spark hands over rows as named tuples, which rename a column "class"
            kind, pos = part["class"], part["pos"]
            turns += int(kind.isin(_TURNS).sum())
            truncated = truncated or bool((kind == "cut").any())
            if before < 0:
                items = pos[kind.isin(_ITEMS)]
                if len(items):
                    cut = int(items.min()) if cut < 0 else min(cut, int(items.min()))
                said.append(pos[kind == "message"])
                called.append(pos[kind == "call"])
            whole = part[kind != "cut"]
            if len(whole):
                at = whole.loc[whole["pos"].idxmin()]
                if first_pos < 0 or at["pos"] < first_pos:
                    first_pos, first_stamp = int(at["pos"]), at["stamp"] if pd.notna(at["stamp"]) else None
            stamped = part[part["stamp"].notna()]
            if len(stamped):
                at = stamped.loc[stamped["pos"].idxmax()]
                if at["pos"] > last_pos:
                    last_pos, last_stamp = int(at["pos"]), at["stamp"]
            asked = part[(part["role"] == "user") & kind.isin(("message", "item-message")) & part["text"].notna()]
            if len(asked):
                at = asked.loc[asked["pos"].idxmin()]
                if asked_pos < 0 or at["pos"] < asked_pos:
                    asked_pos, request = int(at["pos"]), at["text"]
        if before < 0:
            inside = (lambda x: x < cut) if cut >= 0 else (lambda x: x >= 0)
            spoken = spoken or any(inside(x).any() for x in said)
            calls += sum(int(inside(x).sum()) for x in called)
        self.facts.update((turns, calls, spoken, cut, first_pos, first_stamp, last_pos, last_stamp, asked_pos, request, truncated))
        counted = calls if cut < 0 or spoken else 0
        yield pd.DataFrame([(*key, request, first_stamp, last_stamp, turns + counted, cut >= 0, truncated)], columns=[c.split()[0] for c in CATALOG.split(", ")])


def running_catalog(entries: DataFrame) -> DataFrame:
    """One row for each session that a batch touches, in update mode; entries has keys, pos, class, role, text, stamp."""
    with_state_store(entries.sparkSession)
    rows = entries.select(*RunningCatalog.columns)
    return rows.groupBy(*SESSION).transformWithStateInPandas(RunningCatalog(), CATALOG, "update", "none")


class SettledEntries(StatefulProcessor):
    """Passes a session's entries on when it is known that they count."""

    def __init__(self, columns: list[str], types: dict[str, str]):
        self.columns, self.types = columns, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.era = handle.getValueState("era", "spoken boolean, over boolean")
        self.held = handle.getListState("held", ", ".join(f"`{c}` {t}" for c, t in self.types.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spoken, over = self.era.get() if self.era.exists() else (False, False)
        now = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1).sort_values("pos", kind="stable")
        kind, pos = now["class"], now["pos"]
        cut = pos[kind.isin(_ITEMS)].min() if not over and kind.isin(_ITEMS).any() else None
        inside = pos < cut if cut is not None else pd.Series(not over, index=now.index)
        is_call = kind == "call"
        spoken = spoken or bool((inside & (kind == "message")).any())
        decided = spoken or over or cut is not None
        waiting = is_call & inside if not decided else is_call & False
        counts = ~is_call | (is_call & inside & spoken)
        ended = bool((kind == END).any())
        before = list(self.held.get()) if (decided or ended) and self.held.exists() else []
        if decided or ended:
            self.held.clear()
        if before and (spoken or not decided):
            yield pd.DataFrame([tuple(r) for r in before], columns=self.columns)
        if ended:
            counts, waiting = counts | waiting, waiting & False
        if waiting.any():
            self.held.appendList([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row) for row in now[waiting].itertuples(index=False)])
        self.era.update((spoken, over or cut is not None))
        yield now[counts & ~waiting & (kind != END)]


def settled_entries(entries: DataFrame) -> DataFrame:
    """The entries that count, in append mode, with the columns they came with (null-free keys, pos and class needed)."""
    with_state_store(entries.sparkSession)
    processor = SettledEntries(entries.columns, dict(entries.dtypes))
    return entries.groupBy(*SESSION).transformWithStateInPandas(processor, entries.schema, "append", "none")
