"""The pipeline: each stage on what the one before kept, against the operators' own results."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from turnloom.llm import decontamination, sharding, simhash, toxicity
from turnloom.session import BATCH_BYTES, BATCH_SETTING

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = docs.join(scores.where("predicted = 0").select("doc_id"), "doc_id")
    assert ids(P.reject_toxic(spark, docs, FOLDER)) == ids(kept)
    groups = simhash.similar_groups(docs).where("doc_id = component_id")
    assert ids(P.drop_near_duplicates(spark, docs, FOLDER)) == ids(groups)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert ids(P.decontaminate(spark, docs, FOLDER)) == ids(decontamination.contamination(docs, bench).where("n_hit = 0"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and out.limit(1).count() == 1
    final = P.run(spark, FOLDER)
    dealt = {r.doc_id: r.shard for r in sharding.sharded(final.select(*columns)).select("doc_id", "shard").collect()}
    for r in final.collect():
        assert dealt[r.doc_id] == r.to_shard
    for shard in range(8):
        slots = sorted(r.to_slot for r in final.where(f"to_shard = {shard}").collect())
        assert slots == list(range(len(slots)))


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["a`b", "my col", "a.b", "x:y", "of", "_of", "leak", "key", "row", "to_shard", "to_slot", "shard", "slot", "node", "group", "score", "digits", "bucket", "before", "rank", "best", "toxic"]
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, wide, FOLDER)
        assert out.columns == wide.columns
        first = out.first()
        assert [first[n] for n in names] == list(range(len(names)))
    out = P.shard(spark, wide, FOLDER)
    assert out.columns == [*wide.columns, "to_shard_", "to_slot_"]
    assert out.count() == docs.count() and {r[-1] for r in out.select("`to_slot`").collect()} == {names.index("to_slot")}


def test_rows_of_one_id_mix_alike(spark):
    """Which of several rows with one id is repeated does not depend on how the rows lie."""
    docs = spark.createDataFrame([(None if i % 2 else 3, f"w{i} b c", "s" if i % 3 else None) for i in range(60)], "doc_id long, text string, source string")
    rows = lambda n: sorted(map(str, P.mix_sources(spark, docs.repartition(n), FOLDER).collect()))
    assert rows(1) == rows(7)


def test_small_batches(spark):
    """Long texts don't cross to Python all at once in the stages that work there, and a size that the session has stays."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def counts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([len(c)] * len(c))

    for _, stage in P.STAGES[:3]:
        spark.conf.unset(BATCH_SETTING)
        stage(spark, docs, FOLDER)
        assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < BATCH_BYTES + 20_000
        assert max(r[0] for r in texts.select(F.arrow_udf(counts, "long")("text")).collect()) < 60
    spark.conf.set(BATCH_SETTING, "12345678")
    P.run(spark, FOLDER)
    assert spark.conf.get(BATCH_SETTING) == "12345678"
    spark.conf.unset(BATCH_SETTING)
    P.run(spark, FOLDER)
    assert spark.conf.get(BATCH_SETTING, None) is None
