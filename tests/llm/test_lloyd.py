"""op13 against a plain loop over Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import lloyd as L

SHAPE = "vec_id long, embedding array<float>, cluster string, block int"


def brute(rows, dim, clusters, rounds):
    most = 1 << 27
    kept = [(d, [max(-most, min(most, math.floor(256 * x))) for x in v]) for d, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    centroids = [list(v) for _, v in sorted((sha(f"2:{d}"), v) for d, v in kept if d is not None)[:clusters]]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    final = [nearest(v) for _, v in kept]
    by = {i: sum(d for d, c in final if c == i) for i in range(len(centroids))}
    as_long = lambda x: min(x, (1 << 63) - 1)
    return sorted(((d, c, s, as_long(by[c]), as_long(sum(by.values())), sha(",".join(map(str, centroids[c])))) for (d, _), (s, c) in zip(kept, final)), key=repr)


def compare(spark, rows, dim, clusters, rounds, **kind):
    frame = spark.createDataFrame([(d, v, "x", 1) for d, v in rows], SHAPE)
    as_float = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = L.digest(L.clustered(L.quantised(frame.repartition(3), dim=dim), clusters, rounds, dim, **kind)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(as_float, dim, clusters, rounds)


def cases(rng, dim):
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(dim)]) for i in range(120)]
    rows += [(i, [1.0] * dim) for i in range(120, 190)] + [(5, [0.25] * dim), (5, [0.25] * dim), (None, [0.5] * dim), (None, None)]
    return rows + [(200, None), (201, [None] * dim), (202, [math.nan] * dim), (203, [-math.inf] * dim), (204, [1.0] * (dim + 1)), (205, []), (206, [0.0] * dim)]


@pytest.mark.parametrize("width", [3, 7, 10])
def test_loop(spark, width):
    compare(spark, cases(random.Random(width), 7), 7, 9, 3, width=width, chunk=16)


def test_large_components(spark):
    rng = random.Random(4)
    compare(spark, [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 5, 7]) for _ in range(64)]) for i in range(60)], 64, 5, 2)


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])], [(i, [7.0, 7.0]) for i in range(5)]):
        compare(spark, rows, 2, 4, 2)


def test_blocks_apart(spark):
    """Chunks whose blocks lie in different tasks are put together by the shuffle; labels and slices are joined by one too."""
    rows = cases(random.Random(8), 8)
    stored = L.blocks(L.quantised(spark.createDataFrame([(d, v, "x", 1) for d, v in rows], SHAPE), dim=8), 8, 2, 32)
    first = L.starts(L.quantised(spark.createDataFrame([(d, v, "x", 1) for d, v in rows], SHAPE), dim=8), 6, "2", 2)
    want = {r.chunk: (r.labels, r.distances) for r in L.assigned(stored, first, 4, True).collect()}
    apart = stored.repartition(8, "block")
    got = L.assigned(apart, first, 4, False)
    assert {r.chunk: (r.labels, r.distances) for r in got.collect()} == want
    assert L.moved(apart, first, got, 2, False).exceptAll(L.moved(stored, first, L.assigned(stored, first, 4, True), 2, True)).count() == 0


def test_partial_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (300, 1 << 20, 1 << 27):
        v, c = (rng.integers(-most, most, (20, 16)) for _ in range(2))
        assert L.partial_distances(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = L.digest(L.clustered(L.quantised(docs))).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.vec_id, r.embedding) for r in docs.collect()], 64, 40, 5)
    assert L.quantised(docs.withColumn("vector", F.lit("x"))).columns == ["vec_id", "vector"]
