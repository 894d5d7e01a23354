"""op5: findings against brute force, held-out accuracy, odd tables and a native plan."""

import re
import zlib

import numpy as np

from turnloom.llm import secret_forest as S

SHAPE = "doc_id long, text string, source string"


PAIR = re.compile(r"""(?:([A-Za-z][A-Za-z0-9_-]+)["'`]{0,2}[=:]["'`]{0,2})?([A-Za-z0-9+/_-]{8,}={0,2})""")
SECRET = re.compile(S.SECRET_NAMES)


def brute(docs):
    """Findings as they are defined, word by word, without the tests that come before in the operator."""
    out = []
    for d, t, _ in docs:
        words = re.split(r"[ \t\r\n\f\x0B]+", t or "")
        for i, w in enumerate(words):
            before, before2 = (words[i - k] if i >= k else "" for k in (1, 2))
            for n, (name, value) in enumerate(PAIR.findall(w)):
                if not name and n == 0:
                    name = before2 if before in ("=", ":") else before if before.endswith(("=", ":")) else ""
                if (len(value.rstrip("=")) >= 16 and re.search("[0-9]", value)) or SECRET.search(name):
                    out.append((d, i, n))
    return sorted(out, key=str)


def corpus(n=400):
    rng = np.random.default_rng(7)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    docs, truth = [], {}
    for i in range(n):
        kind = i % 6
        hexa = pick("0123456789abcdef", 40)
        word = pick("abcdefghij", 6)
        text = {0: f'{word} token = "{hexa}" {word}', 1: f"{word} commit {hexa} {word}", 2: f"x password={pick('0123456789abcdef', 18)} y", 3: f"card {pick('123456789', 16)} z", 4: f"key AKIA{pick('ABCDEFGHIJ23456789', 16)} z", 5: f"sha256 digest: {hexa} ok"}[kind]
        docs.append((i, f"prose {text} more prose", f"src{i % 3}"))
        truth[i] = kind in (0, 2, 4)
    return docs, truth


def test_findings(spark):
    docs = [*corpus(40)[0], (None, "token=" + "a1" * 20, None), (901, None, "s"), (902, "", "s"), (903, "w " * 40_000 + "token = 'Zz9" + "q8" * 9 + "'", "s"), (903, "short a1", "s")]
    found = S.candidates(spark.createDataFrame([(*d, "x", 1) for d in docs], SHAPE + ", value string, at int"))
    assert sorted(((r.doc_id, r.at, r.run) for r in found.collect()), key=str) == brute(docs)


def test_all_runs_of_a_word(spark):
    """Minified JSON, query strings and lines without blanks give every value with its name."""
    one, two = "0123456789abcdef" * 2, "ghp_" + "a1B2" * 9
    docs = [
        (1, f'{{"commit":"{one}","token":"{two}","n":1}}', "s"), (2, f"https://host/x?commit={one}&token={two}", "s"), (3, f"{one},{two}", "s"),
        (4, "password=hunterhunter", "s"), (5, "db_password: correcthorse", "s"), (6, "api_key = 'abcdefgh'", "s"), (7, "passwords are short; the password is secret", "s"), (8, ",".join(f'"k{i}":"{i:016d}"' for i in range(3000)), "s"),
    ]
    rows = S.candidates(spark.createDataFrame(docs, SHAPE)).collect()
    assert sorted(((r.doc_id, r.at, r.run) for r in rows), key=str) == brute(docs)
    pairs = lambda d: [(r.name, r.value) for r in sorted(rows, key=lambda r: r.run) if r.doc_id == d]
    assert pairs(1) == [("commit", one), ("token", two)] and pairs(3) == [("", one), ("", two)]
    assert ("token", two) in pairs(2) and len(pairs(8)) == 3000
    assert pairs(4) == [("password", "hunterhunter")] and pairs(5) == [("db_password:", "correcthorse")] and pairs(6) == [("api_key", "abcdefgh")] and pairs(7) == []


def test_dictionary(spark):
    docs = [(i, "Common words. Common, words\nrare" + str(i), "s") for i in range(30)]
    assert sorted(r[0] for r in S.dictionary(spark.createDataFrame(docs, SHAPE), 60).collect()) == ["common", "words"]


def test_features_of_rules_are_hidden(spark):
    """Without given labels values that no rule decides are judged by what they are like."""
    docs, truth = corpus(400)
    rng = np.random.default_rng(8)
    free = [(1000 + i, "so " + "".join(rng.choice(list("0123456789abcdef"), 18)) + " it", "s") for i in range(40)]
    rows = S.scanned(spark.createDataFrame(docs + free, SHAPE)).collect()
    assert sum(r.doc_id >= 1000 for r in rows) == 40
    assert np.mean([r.is_secret == truth[r.doc_id] for r in rows if r.doc_id < 1000]) == 1.0


def test_trained_on_given_labels(spark):
    docs, truth = corpus()
    frame = spark.createDataFrame(docs, SHAPE)
    places = {d: i for d, i, _ in brute(docs)}
    known = [(d, places[d], int(truth[d])) for d, _, _ in docs if d % 4]
    labelled = spark.createDataFrame(known, "doc_id long, at int, label int")
    rows = S.scanned(frame, labelled).collect()
    held = [r for r in rows if r.doc_id % 4 == 0]
    assert len(held) == 100 and np.mean([r.is_secret == truth[r.doc_id] for r in held]) > 0.97
    own = S.scanned(frame).collect()
    assert len(own) == 400 and np.mean([r.is_secret == truth[r.doc_id] for r in own]) > 0.97


def test_score_is_held_out(spark):
    """No label reaches its own finding's answer: turning a fold's labels round leaves that fold's scores as they are."""
    docs, truth = corpus()
    frame = spark.createDataFrame(docs, SHAPE)
    places = {d: i for d, i, _ in brute(docs)}
    before = {r.doc_id: r for r in S.scanned(frame, spark.createDataFrame([(d, places[d], int(truth[d])) for d, _, _ in docs], "doc_id long, at int, label int")).collect()}
    mine = {d for d, r in before.items() if zlib.crc32(r.value.encode()) % S.FOLDS == 0}
    turned = [(d, places[d], int(truth[d]) ^ (d in mine)) for d, _, _ in docs]
    after = S.scanned(frame, spark.createDataFrame(turned, "doc_id long, at int, label int")).collect()
    assert len(mine) > 50
    assert {r.doc_id: r.score for r in after if r.doc_id in mine} == {d: before[d].score for d in mine}


def test_planted_without_names(spark):
    """Secrets that no rule labels are told from wordy values by their characters."""
    rng = np.random.default_rng(9)
    key = lambda: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), 32)) + "7q"
    wordy = lambda: "-".join(rng.choice(["chapter", "release", "notes", "update", "server", "index"], 4)) + f"-{rng.integers(100)}"
    plain = "chapter release notes update server index "
    docs = [(i, f"{plain} password={key()} here" if i % 2 else f"{plain} https://host/{wordy()} here", "s") for i in range(200)]
    docs += [(1000 + i, f"{plain} it was {key() if i % 2 else wordy()} there", "s") for i in range(100)]
    rows = [r for r in S.scanned(spark.createDataFrame(docs, SHAPE)).collect() if r.doc_id >= 1000]
    assert len(rows) == 100 and all(r.label is None for r in rows)
    assert np.mean([r.is_secret == bool(r.doc_id % 2) for r in rows]) > 0.95


def test_long_names_keep_their_value(spark):
    name = "service_" * 9 + "token"
    rows = S.candidates(spark.createDataFrame([(1, f"x {name}=abcdefgh12 y", "s")], SHAPE)).collect()
    assert [(r.name, r.value) for r in rows] == [(name, "abcdefgh12")]


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "token=" + "a1" * 20, "p"), (2, "token=" + "a1" * 20, "p")], SHAPE)
    rows = S.digest(S.scanned(frame)).collect()
    assert [(r.doc_id, r.is_secret) for r in rows] == [(2, True)] * 2
    assert S.digest(S.scanned(frame.limit(0))).count() == 0


def test_plan_is_native(spark):
    plan = S.digest(S.scanned(spark.createDataFrame(corpus(40)[0], SHAPE)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
