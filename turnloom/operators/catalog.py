"""The session catalog: one row per session from its turns, listing order, censuses and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.text import cut_after, cut_within, first_line, first_visible_line
from turnloom.session import written

SESSION = ["agent", "home", "session_id"]
UNTITLED = "(untitled)"


def title(text: Column, layout: str) -> Column:
    """A session's title from its first request: layouts differ in which line and how it is cut."""
    return cut_after(first_line(text), 80) if layout == "claude-code" else cut_within(first_visible_line(text), 80)


def sessions(turns: DataFrame, layout: str = "claude-code") -> DataFrame:
    """session keys, title, started_at, updated_at, turn_count: first and last in file order, not by time."""
    asked = (F.col("role") == "user") & (F.col("kind") == "message")
    rows = turns.groupBy(*SESSION).agg(
        F.min_by(F.when(asked, F.col("text")), F.when(asked, F.col("idx"))).alias("request"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("idx"))).alias("started_at"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("idx"))).alias("updated_at"),
        F.count("*").alias("turn_count"),
    )
    return rows.withColumn("title", F.coalesce(F.nullif(title(F.col("request"), layout), F.lit("")), F.lit(UNTITLED))).drop("request")


def listing(catalog: DataFrame) -> DataFrame:
    """Newest first; rows without a time last; ties by agent, home and id."""
    return catalog.orderBy(F.col("updated_at").desc_nulls_last(), *SESSION)


def numbered(catalog: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of the listing with their numbers from 1; with `most`, only the first so many (a top-k, not a full sort).

    The full listing is range-partitioned by its order: parts are numbered by themselves and shifted by the counts of
    the parts before, one row for each part.
    """
    order = [F.col("updated_at").desc_nulls_last(), *map(F.col, SESSION)]
    if most:
        return catalog.orderBy(*order).limit(most).withColumn("number", F.row_number().over(Window.orderBy(*order)))
    ranged = written(catalog.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "listing")
    counts = ranged.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = ranged.withColumn("number", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(offsets, F.col("_part") == F.col("_of")).withColumn("number", (F.col("number") + F.col("_offset")).cast("int")).drop("_part", "_of", "_offset")


def selected(catalog: DataFrame, number: int) -> DataFrame:
    """The session with that number in the listing."""
    return numbered(catalog, number).where(F.col("number") == number)


def distinct_in_order(value: Column, order: Column) -> Column:
    """An aggregate: distinct non-empty values in the order of their first appearance."""
    filled = F.when(value.isNotNull() & (value != ""), F.struct(order.alias("o"), value.alias("v")))
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x.v))


def first_known(value: Column, order: Column) -> Column:
    """An aggregate: the first value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def census(rows: DataFrame, *kinds: str, text: str = "text") -> DataFrame:
    """Rows and bytes of every kind, with each kind's share of all bytes."""
    counted = rows.groupBy(*kinds).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    return counted.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy()))


def newest(snapshots: DataFrame) -> DataFrame:
    """Of several rows for a session that of the latest updated_at."""
    columns = [c for c in snapshots.columns if c not in SESSION]
    best = snapshots.groupBy(*SESSION).agg(F.max(F.struct(F.col("updated_at").alias("_at"), *columns)).alias("best"))
    return best.select(*SESSION, *[F.col(f"best.{c}").alias(c) for c in columns])


def stale(plans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plans whose session the catalog now has with another updated_at."""
    now = catalog.select(*SESSION, F.col("updated_at").alias("now_updated_at"))
    return plans.join(now, SESSION).where(~F.col("updated_at").eqNullSafe(F.col("now_updated_at")))


def check_not_all_failed(ok: DataFrame, rejects: DataFrame) -> None:
    """Raises for homes from which every session was rejected; single rejects are only listed."""
    good = ok.select("agent", "home").distinct()
    lost = rejects.select("agent", "home").distinct().join(good, ["agent", "home"], "left_anti").limit(20).collect()
    if lost:
        raise RuntimeError("no session could be read: " + ", ".join(f"{r.agent} {r.home}" for r in lost))


def file_digests(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path and SHA-256 of every file below a path. Whole files are read, so this is for session files, not archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Digests that are in one of two snapshots of a tree only, with side "before" or "after"; none if nothing changed."""
    lost, new = before.exceptAll(after), after.exceptAll(before)
    return lost.withColumn("side", F.lit("before")).unionByName(new.withColumn("side", F.lit("after")))
