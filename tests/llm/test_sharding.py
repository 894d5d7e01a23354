"""op7: the law of rendezvous hashing, slots, and written shards."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from turnloom.llm import sharding as H
from turnloom.session import new_folder


def check(rows, docs):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard <= 7 and r.grown_shard in (r.shard, 8)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_cases(spark):
    docs = [(i, f"text é {i}") for i in range(3000)] + [(None, None)] * 3 + [(7, "text é 7"), (5000, ""), (5001, "x" * 300_000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, slot int")
    rows = H.digest(H.sharded(frame)).collect()
    check(rows, docs)
    by = Counter(r.shard for r in rows)
    assert min(by.values()) > 300 and 250 < sum(r.grown_shard == 8 for r in rows) < 420
    again = {r.doc_id: r.shard for r in H.digest(H.sharded(frame.repartition(5))).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    assert H.sharded(frame.limit(0)).count() == 0


def test_weights(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    by = Counter(r.shard for r in H.sharded(frame, [1.0, 2.0, 1.0]).select("shard").collect())
    assert 0.47 < by[1] / 20_000 < 0.53


def test_written(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = new_folder(spark, "shards")
    H.write_shards(docs, path)
    assert spark.read.parquet(path).count() == docs.count()
    check(H.digest(H.sharded(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
