"""A pipeline over documents: toxic documents go, near-duplicates go, benchmark leaks go, sources are mixed, shards are dealt.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last keep the columns of documents. Stages that work in Python ask the session for small
batches, as executors keep what the largest batches of all stages took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import decontamination, mixing, sharding, simhash, toxicity
from turnloom.session import BATCH_SETTING, new_folder, small_batches

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    small_batches(spark)
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike or more: that of the least doc_id.

    Candidates come from SimHash fingerprints by ball hashing and, beyond a ball's reach, from bands of least hashes.
    """
    small_batches(spark)
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    small_batches(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources, repeated where their source is."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it; names that a column of theirs has already get a mark behind."""
    rows = sharding.sharded(docs, keep_rows=True)
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"{name}_")

    return rows.select("row.*", F.col("shard").alias(free("to_shard")), F.col("slot").alias(free("to_slot")))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batches = spark.conf.get(BATCH_SETTING, None)
    try:
        for name, stage in STAGES:
            path = new_folder(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        if batches is None:
            spark.conf.unset(BATCH_SETTING)
    return docs
