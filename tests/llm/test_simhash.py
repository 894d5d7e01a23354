"""op2 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import components
from turnloom.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    prints = [(d, print_of(t)) for d, t in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{p:016x}", least[find(i)]) for i, (d, p) in enumerate(prints))


def test_cases(spark):
    base = " ".join(f"word{i}" for i in range(3000))
    docs = [(i, base.replace(f"word{7 * i} ", f"other{i} ")) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "One two"), (54, "one  two"), (55, "one two three"), (56, base.upper()), (56, base)]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, component_id string, rep string")
    assert sorted(tuple(r) for r in S.digest(S.near_duplicates(frame)).collect()) == brute(docs)
    kept = S.representatives(frame).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [0, 50, 53, 55]


def test_empty_and_null_ids(spark):
    shape = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    frame = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "z z z z z"), (3, "a b c d")], shape)
    assert {(r.doc_id, r.component_id) for r in S.near_duplicates(frame).collect()} == {(None, 3), (3, 3), (None, None)}
    assert sorted(map(str, (r.doc_id for r in S.representatives(frame).collect()))) == ["3", "None"]


def test_links_through_rows_without_ids(spark):
    """0 and 3, 3 and 15 differ by two bits: what links 5 to 9 is a row without an id."""
    rows = [(5, 0), (None, 3), (9, 15), (None, 255 << 20), (None, (255 << 20) + 1), (7, -1), (8, 0x7777 << 40), (None, 0x7777 << 40)]
    got = S.components(spark.createDataFrame(rows, "doc_id long, print long")).collect()
    assert sorted(((r.doc_id, r.print, r.component_id) for r in got), key=repr) == sorted([(5, 0, 5), (None, 3, 5), (9, 15, 5), (None, 255 << 20, None), (None, (255 << 20) + 1, None), (7, -1, 7), (8, 0x7777 << 40, 8), (None, 0x7777 << 40, 8)], key=repr)


def test_few_and_many_links(spark, monkeypatch):
    rng = random.Random(9)
    links = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    few = sorted(map(tuple, components.connected(links).collect()))
    monkeypatch.setattr(components, "FEW", 0)
    assert sorted(map(tuple, components.connected(links).collect())) == few


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in S.digest(S.near_duplicates(docs)).collect()) == want


def test_similar_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, truth = [], {}
    for g in range(60):
        base = [word() for _ in range(300)]
        for c in range(3):
            own = list(base)
            for at in rng.sample(range(300), 2 * c):  # each change touches five shingles
                own[at] = word()
            docs.append((3 * g + c, " ".join(own)))
            truth[3 * g + c] = 3 * g
    rows = S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.component_id // 3 == r.doc_id // 3 for r in rows)
    assert sum(r.component_id == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert S.most_bits(0.8) == 39 and S.most_bits(1.0) == 0


def test_similar_pairs_at_the_limit(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    docs = []
    for g in range(300):
        base = [word() for _ in range(184)]  # 180 shingles
        alike = list(base)
        for i in range(4):
            alike[20 + 40 * i] = word()  # 160 of 200 shingles are shared: 0.8
        other = list(base)
        for i in range(5):
            other[20 + 30 * i] = word()  # 155 of 205 shingles are shared: 0.756
        docs.append((2 * g, " ".join(base)))
        docs.append((2 * g + 1, " ".join(alike if g % 2 else other)))
    rows = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(rows[2 * g + 1] == 2 * g for g in range(1, 300, 2)) >= 0.9 * 150
    assert all(rows[2 * g + 1] == 2 * g + 1 for g in range(0, 300, 2))


def test_members_unlike_the_first_are_compared(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    common = " ".join(word() for _ in range(120))
    docs = []
    for g in range(40):  # all meet through the common words, but only pairs are alike
        own = " ".join(word() for _ in range(40))
        docs += [(2 * g, f"{common} {own}"), (2 * g + 1, f"{common} {own} {word()}")]
    rows = S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(d, d // 2 * 2) for d, _ in docs}


def test_components_of_a_wide_group_are_whole(spark):
    """Of copies that differ from each other by more than from their origin, all links between candidates count."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, lines = [word() for _ in range(150)], []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3, 4))):
            own[at] = word()
        lines.append(" ".join(own))
    sets = [set(S.shingles(x.encode(), 5)) for x in lines]
    least = [S.least_hashes(x.encode(), 5) for x in lines]
    buckets = [set(S.bands(x)) for x in least]
    group, n_links = list(range(len(lines))), 0
    for i in range(len(lines)):
        for j in range(i):
            if buckets[i] & buckets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n_links += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows = S.similar_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(group))
    assert n_links > 20 and len(set(group)) > 1


def test_sketches(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    pairs = []
    for g in range(60):
        a, b = [word() for _ in range(90)], []
        b = a[: 86 - g] + [word() for _ in range(4 + g)]
        pairs.append([S.sketch(S.least_hashes(" ".join(x).encode(), 5)) for x in (a, b)])
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    for r in frame.withColumn("n", S._unlike("a", "b")).collect():
        planes = [[f"{x % 2**64:064b}" for x in side] for side in (r.a, r.b)]
        value = lambda side, i: tuple(side[5 * k + i // 64][i % 64] for k in range(4))
        assert r.n == sum(value(planes[0], i) != value(planes[1], i) for i in range(320))
    assert S.most_unlike(1.0) == 0 and 60 < S.most_unlike(0.8) < 100


def test_texts_that_share_an_id_stay(spark):
    docs = [(3, "a b c d e f g"), (3, "k l m n o p q"), (None, "t u v w x y z")]
    kept = S.representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(docs, key=str)


def _brute(lines, similarity=0.8):
    """The components of all pairs of that similarity, by union of sets."""
    sets, group = [set(S.shingles(x.encode(), 5)) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return dict(enumerate(group))


def test_crowds_of_unlike_texts_meet_by_rare_shingles(spark, monkeypatch):
    """Texts that share a long passage and a band, some of them alike beyond it: few pairs are formed, no link is lost."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage, lines = " ".join(word() for _ in range(150)), []
    for g in range(500):
        own = [word() for _ in range(50)]
        lines.append(f"{passage} {' '.join(own)}")
        if g % 10 == 0:
            own[7] = word()
            lines.append(f"{passage} {' '.join(own)}")
    frame, n_pairs, judged = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), [], S._judged
    monkeypatch.setattr(S, "_judged", lambda pairs, *rest: n_pairs.append(pairs.count()) or judged(pairs, *rest))
    dealt, rare = [], S._rare_buckets
    monkeypatch.setattr(S, "_rare_buckets", lambda crowd, *rest: dealt.append(crowd.count()) or rare(crowd, *rest))
    monkeypatch.setattr(S, "CROWD", 8)  # bands here have about 30 members
    rows = {r.doc_id: r.component_id for r in S.similar_groups(frame).collect()}
    assert dealt[0] > 200
    assert rows == _brute(lines)
    assert sum(n_pairs) < 4 * len(lines)


@pytest.mark.parametrize("seed", range(3))
def test_rare_buckets_hold_every_similar_pair(spark, seed):
    rng = random.Random(20 + seed)
    word = lambda: f"w{rng.randrange(12)}"
    lines = [" ".join(word() for _ in range(rng.choice((0, 1, 4, 9, 60)))) for _ in range(20)]
    for _ in range(60):
        own = rng.choice(lines).split(" ")
        own[rng.randrange(len(own))] = word()
        lines.append(" ".join(own[: len(own) - rng.randrange(3)]))
    lines = sorted(set(lines))
    sets = [set(S.shingles(x.encode(), 5)) for x in lines]
    frame = spark.createDataFrame([(x.encode(), x.encode()) for x in lines], "node binary, line binary")
    buckets = {}
    for r in S._rare_buckets(frame.select("node"), frame, 5, 0.8).collect():
        buckets.setdefault(bytes(r.node).decode(), set()).add(r.bucket)
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert buckets[a] & buckets[b]


def test_crowd_of_none_gives_all_links(spark, monkeypatch):
    """Dealt again from the first member on, groups are those of brute force."""
    monkeypatch.setattr(S, "CROWD", 0)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, lines = [word() for _ in range(150)], []
    for _ in range(80):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 4))):
            own[at] = word()
        lines.append(" ".join(own))
    rows = S.similar_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == _brute(lines)


def test_similar_texts_of_near_fingerprints_meet_without_a_band(spark):
    words = [f"w{i}" for i in range(400)]
    lines = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    print_of = lambda x: S.fingerprint(x.encode(), 5)
    assert bin((print_of(lines[0]) ^ print_of(lines[1])) & (1 << 64) - 1).count("1") <= S.RADIUS
    shape = "doc_id long, node binary, print long, bands array<long>, sketch array<long>"
    prints = docs.mapInArrow(S._banded(5), shape).withColumn("bands", F.array(F.col("doc_id")))
    assert [r.print for r in prints.orderBy("doc_id").collect()] == [print_of(x) for x in lines]
    found = S.similar_labels(prints, docs, 5, 0.8).collect()
    assert {bytes(x) for r in found for x in (r.node, r.label)} == {S._node(x.encode()) for x in lines[:2]}


def test_ball_buckets_hold_every_near_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    prints = [b ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in (0, 0, 1, 2, 3)]
    rows = S.ball_buckets(spark.createDataFrame(list(enumerate(prints)), "node long, print long")).collect()
    own = [{r.bucket for r in rows if r.node == i} for i in range(len(prints))]
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                assert own[i] & own[j]


def test_no_pair_is_compared_in_two_turns(spark, monkeypatch):
    """Texts of one base, many of them not quite similar enough, that share many bands: each pair is formed once, no link is lost."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, lines = [word() for _ in range(150)], []
    for _ in range(90):
        own = list(base)
        for at in rng.sample(range(150), rng.choice((1, 3, 4, 5))):
            own[at] = word()
        lines.append(" ".join(own))
    met, judged = [], S._judged
    monkeypatch.setattr(S, "_judged", lambda pairs, *rest: met.append([(bytes(r.a), bytes(r.b)) for r in pairs.collect()]) or judged(pairs, *rest))
    rows = S.similar_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == _brute(lines)
    formed = [pair for turn in met for pair in turn]
    assert len(met) > 2 and len(formed) < 1.1 * len(set(formed))
