"""Monotone token counts against encoding every prefix."""

import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from turnloom.functions import envelope, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
TEXTS = st.text(alphabet=st.sampled_from("aaeinst  \n\t'.,0é𝄞<|Z_"), max_size=400)


def brute(text, limit=envelope.LIMIT):
    total, start = 0, 0
    while start < len(text):
        end = min(start + 128, len(text))
        for i in range(start + 64, end):
            if not text[i].isspace() and text[i - 1].isspace():
                end = i
                break
        segment = text[start:end]
        total += max(len(WHOLE.encode(segment[:k], add_special_tokens=False).ids) for k in range(1, len(segment) + 1)) if start < limit else len(segment.encode())
        start = end
    return total


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_all_prefixes(text):
    assert envelope.bpe(PATH).estimate(text) == brute(text)


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_never_falls(text, more):
    encoder = envelope.bpe(PATH)
    assert encoder.estimate(text) <= encoder.estimate(text + more) <= len((text + more).encode())


def test_encoder_that_falls():
    """Three letters are one token, fewer are one each: the count of "aab" is 1, of its prefix 2."""
    encoder = envelope.Encoder(lambda t: [m.end() for m in re.finditer(r"\w+|\W", t)], lambda p: 1 if len(p) >= 3 else len(p))
    assert encoder.count("aab") == 1 and encoder.estimate("aab") == 2
    failing = envelope.Encoder(lambda t: [len(t)], lambda p: 1 // 0)
    assert failing.estimate("aé") == 3 and failing.estimate("") == 0


def test_column(spark, monkeypatch):
    tokens.register_encoder("byte-bpe", PATH)
    texts = [None, "", "plain words", "x " * 300, "long " * 60_000]
    rows = spark.createDataFrame(enumerate(texts), "n int, text string").repartition(2).select("n", tokens.estimate(F.col("text"), "byte-bpe").alias("e"), tokens.estimate(F.col("text"), "unknown").alias("h"))
    got = {r.n: (r.e, r.h) for r in rows.collect()}
    assert [got[n][0] for n in range(4)] == [0, 0, brute(texts[2]), brute(texts[3])]
    long = texts[4]
    cut = next(m.start() for m in envelope._SEGMENT.finditer(long) if m.start() >= envelope.LIMIT)
    assert got[4][0] == envelope.bpe(PATH).estimate(long[:cut]) + len(long[cut:])


def test_words_cost_one_split_a_segment():
    split = []

    def ends(text):
        split.append(text)
        return [m.end() for m in re.finditer(r" ?\w+|\s+", text)]

    count = lambda piece: abs(len(piece) - 4) + 1  # noqa: E731  falls and rises as a word grows
    fixed = lambda piece: not piece[-1].isspace()

    def word(piece):
        return None if piece.isspace() else (max(count(piece[:k]) for k in range(1, len(piece) + 1)), count(piece))

    text = " ".join(f"word{'x' * (i % 9)}{i}" for i in range(200))
    whole = envelope.Encoder(ends, count, fixed).estimate(text)
    split.clear()
    assert envelope.Encoder(ends, count, fixed, word).estimate(text) == whole
    assert sorted(x for x in split if not x.isspace()) == sorted(m[0] for m in envelope._SEGMENT.finditer(text))


def test_query_counts_long_texts_to_their_end(spark, tmp_path):
    head = "plain words, and more " * 11_916 + "x "  # 262,154 characters
    texts = [head[: envelope.LIMIT], head + "𝄞 é\n\t tail's end 12345 " * 200, "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.estimate, r.upper_bound) for r in __spark_entry__.queries()["token_envelope"](spark, str(tmp_path)).collect()}
    assert got == {n: (brute(x or "", len(x or "")), len((x or "").encode())) for n, x in enumerate(texts)}
    assert got[1][0] < envelope.bpe(PATH).estimate(texts[1])
