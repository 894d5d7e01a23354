"""op6 against a plain loop."""

import re
from collections import Counter, defaultdict

import pytest

from turnloom.llm import mixing as X


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest / total >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = weight[s] * rest / total
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def verify(rows, docs):
    size = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in docs]
    per = defaultdict(int)
    for _, n, s in size:
        per[s] += n
    target = brute_targets(per)
    source = {d: s for d, _, s in size}
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, n) for d, n, _ in size)
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == per[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5


def test_cases(spark):
    docs = [(i, "w " * (i * 37 % 90), f"s{i % 7}" if i % 7 else None) for i in range(300)] + [(1000 + i, "hot word", "s1") for i in range(400)] + [(2000, None, "s2"), (2001, "", "empty"), (2002, "big " * 20_000, "Z")]
    frame = spark.createDataFrame([(d, t, s, 1, "k") for d, t, s in docs], "doc_id long, text string, source string, size int, key string")
    rows = X.digest(X.mix(frame)).collect()
    verify(rows, docs)
    assert sorted(rows) == sorted(X.digest(X.mix(frame.repartition(7))).collect())
    mixed = X.mixed_documents(frame)
    assert mixed.columns == frame.columns
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    for r in rows:
        assert r.size == 0 or counts[r.doc_id] == -(-r.taken // r.size)


def test_odd_tables(spark):
    shape = "doc_id long, text string, source string"
    assert X.mix(spark.createDataFrame([], shape)).count() == 0
    rows = X.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], shape)).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in rows) == [(1, 0.0, 0), (2, 0.0, 0)]
    twin = [(None, "a b c", "s"), (None, "a b c", "s"), (5, "d e", "s"), (5, "d e", "s")]
    rows = X.mix(spark.createDataFrame(twin, shape)).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) == 15


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    verify(X.mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
