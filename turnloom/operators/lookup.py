"""Batches of session lookups by id or path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import WIDE_SPACE, id_shape

MIN_PREFIX = 6


def id_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, session columns, exact) for every match: whole ids, or prefixes of at least six characters.

    Whole ids are one equi-join. Prefixes are another for each length that queries have (few, as ids are short): ids are
    cut to these lengths, so ids that only begin alike never meet. Queries of less than six characters can only be whole
    ids. Blank queries match nothing.
    """
    wanted = F.lower(F.regexp_replace("query", f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", ""))
    asked = queries.select("query", wanted.alias("_wanted")).where("_wanted != ''").distinct()
    known = catalog.withColumn("_id", F.lower("session_id"))
    whole = asked.join(known, F.col("_wanted") == F.col("_id")).withColumn("exact", F.lit(True))
    lengths = [r[0] for r in asked.select(F.length("_wanted").alias("n")).where(f"n >= {MIN_PREFIX}").distinct().collect()]  # at most an id's length
    if not lengths:
        return whole.drop("_id", "_wanted")
    shorter = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n < F.length("_id"))
    cut = known.select("*", F.explode(shorter).alias("_n")).withColumn("_key", F.substring(F.col("_id"), F.lit(1), F.col("_n")))
    begun = asked.join(cut, F.col("_wanted") == F.col("_key")).withColumn("exact", F.lit(False)).drop("_n", "_key")
    return whole.unionByName(begun).drop("_id", "_wanted")


def id_status(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per query: status (found, ambiguous, not-found), n_candidates, session_id if found, hint.

    Whole ids push prefixes out. Counts and bounds are aggregates, so a query that matches very many sessions is no
    larger a group than any other.
    """
    found = id_matches(queries, catalog)
    counts = found.groupBy("query").agg(
        F.count_if("exact").alias("n_exact"), F.count("*").alias("n_all"),
        F.min(F.when(F.col("exact"), F.col("session_id"))).alias("exact_id"), F.min("session_id").alias("any_id"),
        *[f(F.when(cond, F.col(c))).alias(f"{name}_{tag}_{c}") for c in ("agent", "home") for tag, cond in (("exact", F.col("exact")), ("all", F.lit(True))) for name, f in (("low", F.min), ("high", F.max))],
    )
    rows = queries.select("query").distinct().join(counts, "query", "left")
    whole = F.coalesce(F.col("n_exact") > 0, F.lit(False))
    n = F.coalesce(F.when(whole, F.col("n_exact")).otherwise(F.col("n_all")), F.lit(0))
    varies = lambda c: F.when(whole, F.col(f"low_exact_{c}") != F.col(f"high_exact_{c}")).otherwise(F.col(f"low_all_{c}") != F.col(f"high_all_{c}"))
    narrow = F.concat_ws(" or ", F.when(varies("agent"), F.lit("--agent")), F.when(varies("home"), F.lit("--home")))
    short = F.length(F.regexp_replace("query", f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")) < MIN_PREFIX
    hint = F.when((n == 0) & short, F.lit(f"a prefix needs at least {MIN_PREFIX} characters")).when((n > 1) & (narrow != ""), narrow)
    status = F.when(n == 0, F.lit("not-found")).when(n == 1, F.lit("found")).otherwise(F.lit("ambiguous"))
    one = F.when(n == 1, F.when(whole, F.col("exact_id")).otherwise(F.col("any_id")))
    return rows.select("query", status.alias("status"), n.cast("long").alias("n_candidates"), one.alias("session_id"), hint.alias("hint"))


def source_rank(query: Column, ranks: dict[str, dict[str, int]], agent: Column) -> Column:
    """In which order an agent's sessions are searched for an id of this shape."""
    table = F.create_map(*[F.lit(x) for a, by in ranks.items() for shape, rank in by.items() for x in (f"{a}/{shape}", rank)])
    return F.element_at(table, F.concat(agent, F.lit("/"), id_shape(query)))


def by_rank(rows: DataFrame, query: str, ranks: dict[str, dict[str, int]]) -> DataFrame:
    """rows (query, agent, ...) with place, the agent's place in the search order of its query."""
    order = [source_rank(F.col(query), ranks, F.col("agent")), F.col("agent")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def owner_by_path(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) with the agents of the roots that contain them, as a sorted list; empty where no root does.

    A file's ancestors are exploded and joined to the roots by equality: no range join, and as many rows as path parts.
    """
    parts = F.split("path", "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = files.select("path").distinct().select("path", F.explode(F.array_union(above, F.array("path"))).alias("root"))
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("root"), "agent").distinct()
    owners = ancestors.join(known, "root").groupBy("path").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    return files.join(owners, "path", "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))
