"""Token estimates as columns, and a registry of estimators by model family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.envelope import LIMIT, counted

FRAMING = 4
EXACT_LIMIT = 262_144


def heuristic(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and one for each character outside the basic plane."""
    return (F.ceil(F.octet_length(text) / 4.0) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def upper_bound(text: Column) -> Column:
    """A byte-level tokenizer gives no more tokens than bytes."""
    return F.octet_length(text).cast("long")


_FAMILIES: dict[str, Callable[[Column], Column]] = {"claude": heuristic, "generic": heuristic}


def register_family(name: str, count: Callable[[Column], Column]) -> None:
    """Adds a family; `count` is exact up to EXACT_LIMIT characters and the byte bound holds for the rest."""

    def bounded(text: Column) -> Column:
        head = F.substring(text, 1, EXACT_LIMIT)
        rest = F.greatest(F.lit(0), F.octet_length(text) - F.octet_length(head))
        return (F.coalesce(count(head), upper_bound(head)) + rest).cast("long")

    _FAMILIES[name] = bounded


def register_encoder(name: str, path: str, limit: int | None = LIMIT) -> None:
    """Adds a family that is counted by an encoder's file; see functions.envelope. Its counts never fall as text is appended.

    Behind the first `limit` characters a text is charged by its bytes; with None the encoder counts all of it.
    """
    _FAMILIES[name] = counted(path, limit=limit)


def estimate(text: Column, family: str = "generic") -> Column:
    """The family's estimate; an unknown family counts by the heuristic, null text costs nothing."""
    return F.coalesce(_FAMILIES.get(family, heuristic)(text), F.lit(0).cast("long"))


def turn_cost(family: str = "generic") -> Column:
    """What a turn costs: its text, or for a call its text, name, arguments and outcome, and the framing."""
    call = F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("tool_name", F.lit("")), F.coalesce("arguments_text", F.lit("")), F.coalesce("outcome_line", F.lit("")))
    return estimate(F.when(F.col("tool_name").isNotNull(), call).otherwise(F.col("text")), family) + FRAMING


def budget(share: float, window: Column) -> Column:
    return F.floor(F.lit(float(share)) * window).cast("long")
