"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import written

#: So many links (two nodes each) are few enough for one task, which spares the shuffles' many tiny tasks.
FEW = 100_000
Kept = Callable[[DataFrame, str], DataFrame]


def _large(links: DataFrame, kept: Kept) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "star-both")
    least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, kept: Kept) -> DataFrame:
    """A node and its neighbours below are linked to the least of them."""
    down = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "star-down")
    least = kept(down.groupBy("a").agg(F.min("b").alias("m")), "star-down-least")
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node that has a link, but the least of each component; label is that least node.

    links has columns a and b; links of a node to itself add nothing. Each round is written to the shared folder.
    Hub nodes: minima are pre-aggregated before their shuffle, and the joins read written tables on both sides, so that
    adaptive execution can split a hub's partition. At most FEW links are settled in one task each round, with the same result.
    """
    now = written(links.where("a != b").select("a", "b").distinct(), "links")
    few = now.count() <= FEW
    now = now.coalesce(1) if few else now

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return written(rows, name).coalesce(1) if few else written(rows, name)

    before = None
    for _ in range(rounds):
        now = kept(_small(_large(now, kept), kept), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
