"""Whole rows as one column, so that columns of any name can't clash with those that an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed_row(rows: DataFrame) -> Column:
    """All columns as a struct `row`; `row.*` gives them back."""
    return F.struct(*map(quoted, rows.columns)).alias("row")
