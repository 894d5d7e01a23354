"""A table of the newest snapshot of every session, kept up to date by a stream's batches.

Rows lie in buckets by the hash of their session. A batch writes new versions of the buckets that it touches and of no other,
then a manifest that names the version of every bucket; that file makes the batch visible, whole or not at all. Batch n reads
manifests before n alone, so a batch that is repeated after a failure writes the same rows again.

A row with a null updated_at is older than any other; among equal times the greater row by its columns counts. Sessions are
told apart by agent, home and session_id, nulls included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.catalog import SESSION, newest

#: A bucket should be some MB to some hundred MB: a batch rewrites whole buckets. The number must stay the same for a table.
BUCKETS = 64
_MANIFEST = "bucket int, version long"


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders PREFIX=NUMBER in a folder, of those that were written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    whole = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(x.getName().split("=")[1]) for x in whole if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket by the last manifest (before a batch): at most as many as there are buckets."""
    there = [n for n in _children(spark, f"{path}/manifests", "batch") if before is None or n < before]
    return {r.bucket: r.version for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/batch={there[-1]}").collect()} if there else {}


def _folders(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]


def upsert(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps, of every session, the row of the latest updated_at in the table below a path."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = _versions(spark, path, number)
        batch = batch.persist()
        try:
            bucket = F.pmod(F.xxhash64(*SESSION), F.lit(buckets)).cast("int")
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
            if not touched:
                return
            old = _folders(path, {b: now[b] for b in touched if b in now})
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
            newest(rows).select(*batch.columns).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number}")
            now |= dict.fromkeys(touched, number)
            spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/batch={number}")
        finally:
            batch.unpersist()

    return run


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as its last manifest has it."""
    folders = _folders(path, _versions(spark, path))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes buckets' versions that none of the last `keep` manifests names, and older manifests; returns how many."""
    there = _children(spark, f"{path}/manifests", "batch")
    needed = {f"version={r.version}/bucket={r.bucket}" for n in there[-keep:] for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/batch={n}").collect()}
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f"{path}/manifests/batch={n}" for n in there[:-keep]]
    for version in _children(spark, f"{path}/rows", "version"):
        if version <= max(there, default=-1):
            inside = [x.getPath().getName() for x in fs.listStatus(path_of(f"{path}/rows/version={version}"))]
            gone += [f"{path}/rows/version={version}/{b}" for b in inside if b.startswith("bucket=") and f"version={version}/{b}" not in needed]
    for x in gone:
        fs.delete(path_of(x), True)
    return len(gone)
