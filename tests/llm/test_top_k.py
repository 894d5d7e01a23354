"""op11 against scoring every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.llm import top_k as T

SHAPE = "vec_id long, embedding array<float>, id string, row int, score double"


def brute(rows, k=10, step=100):
    sound = [(i, d, [math.floor(1024 * x) for x in v]) for i, (d, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, d, v in sound:
        if d is not None and d % step == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), e is None, e or 0) for j, e, w in sound if j != i)
            out += [(d, r, None if none else e, -s) for r, (s, none, e) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, v, "x", 1, 0.5) for d, v in rows], SHAPE)


def found(spark, rows, **kind):
    rows = [(d, None if v is None else [x if x is None else float(x) for x in v]) for d, v in rows]
    as_float = [tuple(r) for r in frame(spark, rows).select("vec_id", "embedding").collect()]
    got = T.digest(T.nearest(frame(spark, rows).repartition(3), **kind)).collect()
    return sorted(map(tuple, got), key=repr), brute(as_float)


def test_unlike_rows(spark):
    rng = random.Random(1)
    vector = lambda n: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, vector(8)) for i in range(1500)]
    same = vector(8)
    rows += [(i, same) for i in range(1500, 2600)]  # a large group of equal vectors, whose ties go by id
    rows += [(i, [0.0] * 8) for i in range(2600, 2640)] + [(700, vector(8)), (700, same), (700, same), (None, same), (None, vector(8))]
    rows += [(3000, None), (3100, [None, 1.0]), (3200, [math.nan] * 8), (3300, [math.inf] * 8), (3400, []), (3500, vector(5)), (3501, vector(20)), (3600, vector(20))]
    got, want = found(spark, rows)
    assert got == want


def test_small_tables(spark):
    assert T.nearest(frame(spark, [])).count() == 0
    assert T.nearest(frame(spark, [(100, [1.0, 2.0])])).count() == 0
    for rows in ([(100, [1.0, -2.0]), (100, [1.0, -2.0])], [(1, [1.0]), (2, [2.0])], [(0, None)], [(0, []), (5, [])], [(i, [0.1 * i, -1.0]) for i in range(-300, -290)]):
        got, want = found(spark, rows)
        assert got == want


def test_large_numbers(spark):
    """Products beyond what doubles hold exactly, and scores beyond a long."""
    rng = random.Random(2)
    got, want = found(spark, [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([1, 6, 9, 30]) for _ in range(4)]) for i in range(250)])
    assert got == want


def test_ranges_and_batches(spark, monkeypatch):
    """The same rows whatever the sizes of blocks, ranges and batches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([tuple(r) for r in docs.select("vec_id", "embedding").collect()], step=20)
    for name, value in {"QUERY_BYTES": 3000, "PIVOTS": 7}.items():
        monkeypatch.setattr(T, name, value)
    numbered, ranges = T.index(T.quantised(docs), block=4, most_rows=16)
    assert ranges.agg(F.sum(F.size("ids"))).first()[0] == 500 and ranges.count() >= 500 / 16
    assert sorted(map(tuple, T.digest(T.top_k(numbered.where("id % 20 = 0"), ranges, 10)).collect()), key=repr) == want


@pytest.mark.parametrize("partitions", [1, 9])
def test_whole_table(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([tuple(r) for r in docs.select("vec_id", "embedding").collect()])
    assert sorted(map(tuple, T.digest(T.nearest(docs.repartition(partitions))).collect()), key=repr) == want
