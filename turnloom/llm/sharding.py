"""Sharding by weighted rendezvous hashing of stable record keys.

A record's score in a shard of weight w is -w / ln(u), where u is a hash of its key and the shard in (0, 1); the shard
of highest score has the record. A shard's score depends on nothing but key and shard, so one more shard takes records
only into itself. Slots number each shard's rows without gaps, from bucketed prefix sums: no shard goes through one task.

Defined results: a null key counts as the word "null"; null text has no bytes and the checksum of nothing; rows with
equal keys share a shard and have slots of their own; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.prefix_sums import bucket_of, bucket_offsets, running_sums, total_buckets
from turnloom.llm.rows import packed_row
from turnloom.session import written

SHARDS = 8


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of highest score. The work per record grows with the number of shards."""
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def scored(shard: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(2.0**53)
        return F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(shard).alias("shard"))

    scores = [scored(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def sharded(documents: DataFrame, weights: list[float] | None = None, grown: float = 1.0, keep_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard (with one more shard of weight `grown`).

    With keep_rows, `row` holds the whole input row as well.
    """
    weights = weights or [1.0] * SHARDS
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    columns = [
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(binary).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown]).cast("int").alias("grown_shard"),
    ]
    buckets = F.lit(max(1, total_buckets(documents.sparkSession) // len(weights)))
    key = F.xxhash64("doc_id", "size", "text_crc32")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key"), buckets))

    thin = written(placed(documents.select(*columns)), "shard-rows")
    offsets = written(bucket_offsets(thin, "shard", F.lit(1)), "shard-offsets")
    rows = thin
    if keep_rows:
        rows = placed(documents.select(packed_row(documents), *columns))
    sums = running_sums(rows, offsets, "shard", ["key", "doc_id"], F.lit(1), "slot")
    return sums.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", *["row"] * keep_rows)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of sharded()."""
    return result.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(documents: DataFrame, path: str, weights: list[float] | None = None) -> None:
    """Writes the documents as Parquet, one folder shard=N for each shard, in the order of their slots within each file."""
    rows = sharded(documents, weights, keep_rows=True)
    rows.select("row.*", "shard", "slot").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
