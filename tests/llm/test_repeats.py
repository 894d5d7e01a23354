"""op10 against brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from turnloom.llm import repeats as R
from turnloom.llm import tokens_np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, span=13):
    lists = [(d, WORD.findall(t or "")) for d, t in docs]
    least = {}
    rank = lambda d: float("inf") if d is None else d
    for d, w in lists:
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            least[k] = min(least.get(k, float("inf")), rank(d))
    out = []
    for d, w in lists:
        gone = set()
        for i in range(len(w) - span + 1):
            if least[tuple(w[i : i + span])] < rank(d):
                gone |= set(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


PASSAGE = " ".join(f"p{i}" for i in range(60))
DOCS = [(i, f"start{i} " * (i % 3) + PASSAGE + f"\n end{i} é") for i in range(40)] + [(50, None), (51, ""), (52, " \t\n"), (53, "short one"), (54, "same " * 400), (55, "same " * 12), (56, "same " * 13), (None, PASSAGE), (None, "lonely " + PASSAGE), (57, " ".join(f"q{i}" for i in range(13))), (57, " ".join(f"q{i}" for i in range(13))), (58, " ".join(f"q{i}" for i in range(14))), (59, "word joined " * 30)]


def rows(spark, docs, parts=3, **options):
    frame = spark.createDataFrame([(d, t, "x", 3, "y") for d, t in docs], "doc_id long, text string, of string, kept int, part string").repartition(parts)
    result = R.without_repeats(frame, texts=False, **options).select("doc_id", "n_words", "n_removed", "kept")
    return sorted((tuple(r) for r in result.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"part_bytes": 200, "group": 40}, {"part_bytes": 1 << 30}])
def test_cases(spark, options):
    assert rows(spark, DOCS, **options) == brute(DOCS)


def test_one_hot_prefix(spark):
    """Many different suffixes with one beginning of four words, and a passage that half of the documents have."""
    docs = [(i, " ".join(f"a b c d {i} {j}" for j in range(30)) + (" " + PASSAGE if i % 2 else "")) for i in range(80)]
    assert rows(spark, docs, group=100, part_bytes=4000) == brute(docs)


def test_short_texts_and_null_ids(spark):
    short = [(i if i % 3 else None, "a few words only") for i in range(200)]
    assert rows(spark, short) == brute(short)
    unnamed = [(None, f"{PASSAGE} {i % 5}") for i in range(60)]
    assert rows(spark, unnamed, part_bytes=1000) == brute(unnamed)
    assert rows(spark, [*unnamed, (3, PASSAGE)], part_bytes=1000) == brute([*unnamed, (3, PASSAGE)])


def test_words_are_compared(spark):
    """Two words of one 64-bit value make windows of one value, which are not repeats."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    others = " ".join(f"z{i}" for i in range(12))
    docs = [(1, f"{one} {others}"), (2, f"{two} {others}"), (3, f"{two} {others}")]
    assert [r[2] for r in rows(spark, docs)] == [0, 0, 13]


def test_all_paths_of_one_value(spark, monkeypatch):
    """The words decide even if every suffix has one value."""
    monkeypatch.setattr(R, "grams", lambda words, n: np.full(max(0, len(words) - n + 1), 5, np.uint64))
    frame = pa.table({"doc_id": [1, 2, 3], "text": [PASSAGE, " ".join(f"q{i}" for i in range(60)), PASSAGE + " end"], "part": [0, 0, 0]})
    prefixes = R.Prefixes(np.ones((len(R.levels(13)), 4), dtype=np.int64), 10)
    shared = R._shared_values(R._sent_values(13, 0)(frame))
    found = R._subtree(R._leaves(13, 0, prefixes)(frame, shared), 13)
    assert R._kept(13, False)(frame, found).column("n_removed").to_pylist() == [0, 0, 60]


def test_spans_are_maximal_repeats(spark):
    docs = [(1, PASSAGE), (2, f"x y {PASSAGE} z {PASSAGE} w"), (3, "nothing here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.kept, [tuple(s) for s in r.spans]) for r in R.without_repeats(frame).collect()}
    assert got == {1: (PASSAGE, []), 2: ("x y z w", [(2, 62), (63, 123)]), 3: ("nothing here", [])}


def test_prefixes_split_heavy_bins():
    counts = np.array([[5, 95, 0, 3], [10, 20, 30, 43], [1, 99, 1, 2]])
    prefixes = R.Prefixes(counts, 40)
    assert prefixes.of[0].tolist() == [0, -1, 0, 0] and prefixes.of[1][3] == -1 and min(prefixes.of[2]) > max(prefixes.of[1])
    assert all(np.bincount(t[t >= 0], weights=c[t >= 0]).max() <= 80 for t, c in zip(prefixes.of[:2], counts, strict=False))


def test_a_part_sends_equal_suffixes_once():
    frame = pa.table({"doc_id": list(range(30)), "text": [PASSAGE] * 30, "part": [0] * 30})
    prefixes = R.Prefixes(np.ones((len(R.levels(13)), 16), dtype=np.int64), 100)
    sent = R._leaves(13, 0, prefixes)(frame, R._shared_values(R._sent_values(13, 0)(frame)))
    windows = [x for w in sent.column("words").to_pylist() if w is not None for x in R._windows(w, 13)[0]]
    assert len(windows) == 48 and set(windows) == {" ".join(PASSAGE.split()[i : i + 13]).encode() for i in range(48)}
    assert sum(len(stretch) for w in sent.column("words").to_pylist() if w is not None for stretch in w.split(b"\n")) < 6 * len(PASSAGE)


def test_empty(spark):
    assert R.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in R.digest(docs).collect()), key=str) == want
    assert any(r[2] for r in want)


def test_memory_is_bounded_where_all_is_shared(monkeypatch):
    """A part and a group need a few bytes for each byte of text, even if each suffix is another part's too."""
    monkeypatch.setattr(tokens_np, "PIECE_BYTES", 1 << 15)  # pieces are small beside a part
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 1000).tolist())) for _ in range(60)]
    parts = [pa.table({"doc_id": list(range(k * 60, k * 60 + 60)), "text": texts, "part": [k] * 60}) for k in range(2)]
    size = sum(map(len, texts))
    prefixes = R.Prefixes(np.ones((len(R.levels(13)), 4), dtype=np.int64), 10)

    def measured(step, *tables):
        step(*tables)  # tables of tokens_np stay
        tracemalloc.start()
        out = step(*tables)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * size, (step, peak / size)
        return out

    sent = pa.concat_tables([measured(R._sent_values(13, 0), p) for p in parts])
    shared = R._shared_values(sent)
    of = lambda table, k: table.filter(pc.equal(table.column("part"), k))
    leaves = [measured(R._leaves(13, 0, prefixes), p, of(shared, k)) for k, p in enumerate(parts)]
    found = measured(lambda table: R._subtree(table, 13), leaves[1])
    assert found.num_rows == 0
    found = R._subtree(pa.concat_tables(leaves), 13)
    assert [sum(measured(R._kept(13, False), p, of(found, k)).column("n_removed").to_pylist()) for k, p in enumerate(parts)] == [0, 60_000]
