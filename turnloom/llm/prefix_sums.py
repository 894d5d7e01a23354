"""Running sums within groups of any size, over rows in the order of a uniform hash.

A group's hash range is cut into buckets of about equal rows (the hash is uniform, so no sampling is needed), the
buckets' totals are summed up over the few buckets of each group, and each bucket is sorted and summed by itself. No
task holds more than one bucket's rows at a time, however much of the table one group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import written

_SPREAD = 16
_RUN = 64


def total_buckets(spark: SparkSession) -> int:
    """How many buckets all groups share: some for each shuffle partition, so that uneven buckets even out."""
    return _SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(key: Column, buckets: Column) -> Column:
    """The bucket of a signed 64-bit hash; buckets follow the order of the hash."""
    share = (key.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.least(F.floor(share * buckets), buckets - 1).cast("long")


def bucket_offsets(rows: DataFrame, group: str, measure: Column) -> DataFrame:
    """(of_group, of_bucket, offset): what the measure sums to in the buckets before, for rows with `group` and `bucket`.

    Sums run within runs of _RUN buckets and over the runs' totals, so a group's buckets need not meet in one task.
    """
    totals = rows.groupBy(F.col(group).alias("of_group"), F.col("bucket").alias("of_bucket")).agg(F.sum(measure).alias("subtotal"))
    totals = written(totals.withColumn("run", F.floor(F.col("of_bucket") / _RUN)), "bucket-totals")
    whole = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy(F.col("of_group").alias("g"), F.col("run").alias("r")).agg(F.sum("subtotal").alias("total"))
    runs = runs.select("g", "r", F.coalesce(F.sum("total").over(whole("g").orderBy("r")), F.lit(0)).alias("earlier"))
    inside = totals.withColumn("inner", F.coalesce(F.sum("subtotal").over(whole("of_group", "run").orderBy("of_bucket")), F.lit(0)))
    joined = inside.join(runs, F.col("of_group").eqNullSafe(F.col("g")) & (F.col("run") == F.col("r")))
    return joined.select("of_group", "of_bucket", (F.col("earlier") + F.col("inner")).alias("offset"))


def running_sums(rows: DataFrame, offsets: DataFrame, group: str, order: list[str], measure: Column, name: str) -> DataFrame:
    """rows with column `name`: the measure's sum over the rows before, in the group's order (bucket, then `order`)."""
    earlier = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum(measure).over(earlier), F.lit(0)))
    joined = inside.join(offsets, F.col(group).eqNullSafe(F.col("of_group")) & (F.col("bucket") == F.col("of_bucket")))
    return joined.withColumn(name, (F.col("offset") + F.col("inside")).cast("long")).drop("of_group", "of_bucket", "offset", "inside")
