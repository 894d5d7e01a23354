"""op8: held-out accuracy, blindness to labels and languages, and odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import toxicity as T


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    labels = np.asarray(labels)
    n1, n0 = labels.sum(), (1 - labels).sum()
    return (order[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("na", "ro", "lik", "sem")]
    docs = []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(20, 200)))
        toxic = i % 8 == 0
        if toxic:
            for w in rng.choice(["vilebad", "grubnasty", "zorkhead"], 3):
                text.insert(int(rng.integers(0, len(text))), str(w) + "xyz"[int(rng.integers(3))])
        docs.append((i, " ".join(text), "en", "s", int(toxic) if rng.random() > 0.03 else int(not toxic), int(toxic)))
    return docs


def test_held_out(spark, corpus):
    frame = spark.createDataFrame([d[:4] for d in corpus], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(d[0], 1, d[4]) for d in corpus], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in T.toxicity(frame, labels).collect()}
    assert len(rows) == len(corpus)
    held = [d for d in corpus if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert {d[0] for d in held} == {i for i, r in rows.items() if r.held_out}
    assert auc([d[5] for d in held], [rows[d[0]].score for d in held]) > 0.99
    assert np.mean([rows[d[0]].predicted == d[5] for d in held]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    # held-out labels, ids and languages change nothing
    other = spark.createDataFrame([(d[0], 1, 1 - d[4] if rows[d[0]].held_out else d[4]) for d in corpus], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in T.toxicity(frame.drop("lang"), other).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in rows.items())
    clean = T.clean_documents(frame, labels)
    assert clean.columns == frame.columns and clean.count() == sum(r.predicted == 0 for r in rows.values())


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "word " * 30_000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score < 0.3, r.predicted) for r in T.toxicity(frame, empty).collect()} == {(True, 0)}
    one = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 0, 1), (99, 1, 0), (4, 1, 1), (4, 1, 1)], empty.schema)
    assert T.toxicity(frame, one).count() == 4
    assert T.toxicity(frame.limit(0), one).count() == 0


def test_label_model_finds_noise():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.1
    votes = np.zeros((4000, T.LEXICON_VOTERS + 5), dtype=bool)
    for j in range(T.LEXICON_VOTERS):
        votes[:, j] = np.where(truth, rng.random(4000) < 0.3, rng.random(4000) < 0.003)
    votes[:, -1] = np.where(rng.random(4000) < 0.05, ~truth, truth)
    posterior = T.label_model(votes, float(votes[:, -1].mean()))
    assert ((posterior > 0.5) == truth).mean() > 0.995


def test_rare_toxic_words_are_found_among_many_common_ones(spark):
    """60,000 common words are in more toxic documents than the toxic word is."""
    common = [" ".join(f"{chr(97 + i % 26)}{i:05d}" for i in range(part, 60_000, 4)) for part in range(4)]
    docs = [(i, common[i // 2 % 4] if i < 200 else f"vilebad{i % 3} x{i}" if i < 260 else f"fine day {i}") for i in range(600)]
    labels = [(i, int(i < 200 and i % 2 or 200 <= i < 216)) for i, _ in docs if not 216 <= i < 260]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    beginnings = next(T._features(pa.array(["vilebad1"])))[1][1:]
    assert len(beginnings) == 3 and set(beginnings) <= set(model.values)


def test_entries_beyond_what_is_sent_give_the_same_scores(spark, corpus, monkeypatch):
    frame = spark.createDataFrame([d[:4] for d in corpus], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(d[0], d[4]) for d in corpus], "doc_id long, toxic int")
    sent = T.fit(frame, labels)
    monkeypatch.setattr(T, "MOST_SENT", 0)
    joined = T.fit(frame, labels)
    assert len(sent.values) and (sent.values == joined.values).all()
    assert np.allclose(sent.weights, joined.weights, atol=1e-12)


def test_counts_and_scores_by_brute_force(spark, corpus):
    """Entries are recounted by plain loops, and scores are added up entry by entry."""
    frame = spark.createDataFrame([d[:2] for d in corpus], "doc_id long, text string")
    model = T.fit(frame, spark.createDataFrame([(d[0], d[4]) for d in corpus], "doc_id long, toxic int"))
    taught = [d for d in corpus if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    of = {d[0]: {b.decode() for w in d[1].encode().split() for b in (b"=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n))} for d in corpus}
    counts, totals = {}, [0, 0]
    for d in taught:
        totals[d[4]] += 1
        for x in of[d[0]]:
            counts.setdefault(x, [0, 0])[d[4]] += 1
    tried = {x: c for x, c in counts.items() if c[1] >= T.LEAST_DOCUMENTS}
    least = np.sqrt(2 * np.log(len(tried)))
    good = {x for x, (c0, c1) in tried.items() if T.likelihood_ratio(np.float64(c1), np.float64(c0), totals[1], totals[0]) > least and T.surely(np.float64(c1), np.float64(c1 + c0)) >= T.LEAST_PRECISION}

    def value(x):
        values = next(T._features(pa.array([x[1:] if x[0] == "=" else x + "q"])))[1]
        return values[0] if x[0] == "=" else values[len(x) - 3]

    by_value = {int(value(x)): x for x in good}
    assert set(by_value) == set(map(int, model.values))
    weight = {by_value[int(v)]: w for v, w in zip(model.values, model.weights[: len(model.values)], strict=True)}
    for r in T.scored(frame, model).collect():
        odds = model.weights[-1] + sum(weight[x] for x in of[r.doc_id] if x in weight)
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
