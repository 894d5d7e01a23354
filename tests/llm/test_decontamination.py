"""op1 against brute force, over the smallest tables and hand-made cases."""

import hashlib
import re

import pytest

from turnloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item string, print long"
ITEMS = "item_id long, text string, extra string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ours(spark, docs, items, **more):
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in D.digest(D.contamination(left, right, **more)).collect()), key=str)


PASSAGE = " ".join(f"w{i}" for i in range(25))
CASES = [(1, None), (2, ""), (3, "!!! ..."), (4, PASSAGE), (5, "A " + PASSAGE.upper() + "! b"), (6, "w0 w1 w2, w3-w4 w5 w6 w7 w8"), (6, "w0 w1 w2, w3-w4 w5 w6 w7 w8 w9"), (None, "é ü w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (7, "one two"), (8, "three one two one two"), (9, "x " * 40), (10, ("tok " * 9 + "end ") * 400)]
BENCH = [(1, PASSAGE), (2, "one two"), (2, "one two"), (3, None), (4, ""), (5, "x " * 12), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (11, "tok " * 9 + "end"), (12, "a b c d e f g")]


@pytest.mark.parametrize("most_sent", [D.MOST_SENT, 0])
def test_cases(spark, most_sent):
    assert ours(spark, CASES, BENCH, most_sent=most_sent) == brute(CASES, BENCH)


def test_empty_tables(spark):
    assert ours(spark, [], BENCH) == []
    assert ours(spark, CASES, []) == brute(CASES, [])


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in D.digest(D.contamination(docs, items)).collect()), key=str) == want
    assert any(r[-1] for r in want)


def test_clean_rows_keep_although_ids_repeat(spark):
    leak = " ".join(f"w{i}" for i in range(12))
    docs = [(None, leak), (None, "clean one"), (7, f"x {leak}"), (7, "clean two"), (8, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([("a", leak)], "item_id string, text string")
    for most in (D.MOST_SENT, 0):
        kept = D.clean_documents(frame, bench, most_sent=most)
        assert kept.columns == frame.columns and {tuple(r) for r in kept.collect()} == {docs[1], docs[3], docs[4]}


def test_hot_windows(spark):
    """A phrase that many items share and many documents repeat meets each document once, not once for each item and place."""
    phrase = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    docs = [(d, " ".join([phrase] * 20) + f" end{d}") for d in range(300)]
    items = [(i, f"{phrase} item{i}") for i in range(200)] + [(900, phrase), (901, "other words")]
    for most in (D.MOST_SENT, 0):
        rows = ours(spark, docs, items, most_sent=most)
        assert len(rows) == 300 and {(r[2], r[3]) for r in rows} == {(200, 201)}
    assert ours(spark, docs[:3], items) == brute(docs[:3], items)
