"""The canonical tables as files: turns, sessions, plans and rejects, in folders by agent.

Rows of a session lie together: they are dealt by ranges of home, session and place, so that one large session or agent
takes as many files as its size asks for, and readers of some sessions skip the other files by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that order a table's rows, as far as it has them.
ORDER = ("agent", "home", "session_id", "idx", "target")


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Writes each table as Parquet below folder/name, in folders agent=...; refuses a folder that is there already."""
    for name, rows in tables.items():
        order = [F.col(c).asc_nulls_first() for c in ORDER if c in rows.columns]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("agent").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; filters on agent read that agent's folder only."""
    return spark.read.parquet(f"{folder}/{name}")
