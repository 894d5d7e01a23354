"""The era rule as a stream against the batch rule, however the lines are cut into batches; snapshots in buckets."""

import random

from pyspark.sql import functions as F

from turnloom.operators import catalog
from turnloom.sources import codex
from turnloom.streaming import eras, snapshots

SHAPE = "agent string, home string, session_id string, pos long, class string, role string, text string, stamp string"


def sessions(rng, n):
    rows = []
    for s in range(n):
        kinds = rng.choice([["call", "none"], ["call", "message"], ["call", "item-call", "none"], ["call", "message", "item-message", "item-call", "summary", "cut", "unknown"], ["call", "call", "call", "message", "item-call"]])
        for pos in range(rng.randrange(1, 14)):
            kind = rng.choice(kinds)
            text = f"t{s}.{pos}" if "message" in kind else None
            rows.append(("codex", "/h", f"s{s}", pos, kind, rng.choice(["user", "agent"]), text, rng.choice([None, f"2026-01-01T00:00:{pos:02d}Z"])))
    return rows


def in_batches(spark, rows, folder, stream, run, cuts=(3, 7)):
    """Writes each session's lines up to each cut, and runs the stream after each with one checkpoint."""
    source = str(folder / "in")
    for i, (a, b) in enumerate(zip((0, *cuts), (*cuts, 10**9), strict=True)):
        spark.createDataFrame([r for r in rows if a <= r[3] < b], SHAPE).repartition(2).write.mode("append").parquet(source)
        out = stream(spark.readStream.schema(SHAPE).parquet(source))
        run(out, i)


def test_running_catalog(spark, tmp_path):
    rows = sessions(random.Random(3), 60)
    path, put = str(tmp_path / "table"), snapshots.upsert(str(tmp_path / "table"), buckets=5)

    def run(out, i):
        out.withColumnRenamed("updated_at", "at").withColumn("updated_at", F.lit(f"{i}")).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        so_far = spark.createDataFrame([r for r in rows if r[3] < (3, 7, 10**9)[i]], SHAPE)
        kept = codex.in_scope(so_far).where(F.col("class").isin("message", "item-message", "summary", "call", "item-call")).groupBy("session_id").agg(F.count("*").alias("n"))
        facts = so_far.groupBy("session_id").agg(
            F.min_by("stamp", F.when(F.col("class") != "cut", F.col("pos"))).alias("a"), F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("pos"))).alias("b"),
            F.min_by("text", F.when((F.col("role") == "user") & F.col("class").isin("message", "item-message"), F.col("pos"))).alias("r"), F.bool_or(F.col("class") == "cut").alias("t"),
            F.bool_or(F.col("class").isin("item-message", "item-call")).alias("m"),
        )
        want = facts.join(kept, "session_id", "left").select("session_id", "r", "a", "b", F.coalesce("n", F.lit(0)), "m", "t").collect()
        got = snapshots.read(spark, path, eras.CATALOG.replace("updated_at", "at") + ", updated_at string").select("session_id", "request", "started_at", "at", "turn_count", "mixed", "truncated").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))

    in_batches(spark, rows, tmp_path, eras.running_catalog, run)
    assert snapshots.vacuum(spark, path, keep=1) > 0
    assert snapshots.read(spark, path, eras.CATALOG).count() == 60


def test_settled_entries(spark, tmp_path):
    rows = sessions(random.Random(5), 60)
    want = sorted(map(tuple, codex.in_scope(spark.createDataFrame(rows, SHAPE)).select("session_id", "pos", "class", "text").collect()))
    out = str(tmp_path / "out")

    def run(stream, i):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    ends = [("codex", "/h", f"s{s}", 99, eras.END, None, None, None) for s in range(60)]
    in_batches(spark, rows + ends, tmp_path, eras.settled_entries, run)
    assert sorted(map(tuple, spark.read.schema(SHAPE).parquet(out).select("session_id", "pos", "class", "text").collect())) == want


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    shape = "agent string, home string, session_id string, updated_at string, n int"
    put = snapshots.upsert(path, buckets=8)
    table = lambda: sorted(map(tuple, snapshots.read(spark, path, shape).collect()))
    assert table() == []
    rng = random.Random(1)
    batches = [[("a", "h", f"s{rng.randrange(20)}", f"{rng.randrange(100):03d}", i) for _ in range(k)] for i, k in enumerate((30, 1, 0, 12, 1))]
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, shape)
        put(batch, i)
        before = table()
        put(batch, i)  # repeated after a failure
        so_far = spark.createDataFrame([r for b in batches[: i + 1] for r in b], shape)
        assert table() == before == sorted(map(tuple, catalog.newest(so_far).select("agent", "home", "session_id", "updated_at", "n").collect()))
    # One row touches one bucket: the others keep their version.
    assert list(snapshots._versions(spark, path).values()).count(4) == 1
    before = table()
    assert snapshots.vacuum(spark, path) > 0 and table() == before
