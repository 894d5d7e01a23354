"""op3: round trip against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import token_orc as T
from turnloom.llm.queries import TOKENIZER
from turnloom.session import new_folder

ENCODER = T.Encoder(TOKENIZER)
ODD = ["", "a", " ", "  ", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "it's we'll  I'd", "x  y", "x  y", "\x1c a", "tab\t b", "é ü  ß", "1 22  333", "... !!! ?", "🙂 🙂  🙂", "a" * 300 + " b", "w " * 5000, "<|endoftext|> a", "a <|endoftext|> b", "\r\n \r\n x", "end. of, a: list; of! marks? a.b c., ñandú, 12, a1, (x), \u4f60\u597d, \u0251,"]


def brute(docs):
    tokenizer, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    values, offsets = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [values[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def plain(texts):
    return [[*ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@pytest.mark.parametrize("text", ODD)
def test_encoder(text):
    texts = [text, "x", text, "", text, ".", text, "\n", text, " ", text]
    assert encoded(T.Encoder(TOKENIZER), texts) == plain(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.,\n\t'é×ß\u00a0\u2003\u0451你1!", max_size=12), min_size=1, max_size=6))
def test_encoder_random(texts):
    assert encoded(ENCODER, texts) == plain(texts)


def test_small_memo(monkeypatch):
    monkeypatch.setattr(T, "MOST_PIECES", 3)
    encoder = T.Encoder(TOKENIZER)
    for text in ("a b c d e f g", "a b", "h i j k", "a b c d"):
        assert encoded(encoder, [text]) == plain([text])


def test_cases(spark):
    docs = [(7 * i % 101, t) for i, t in enumerate(ODD)] + [(500, None), (None, "no id"), (-3, "below zero")]
    frame = spark.createDataFrame([(d, t, 1, "f") for d, t in docs], "doc_id long, text string, ids int, file string")
    assert sorted((tuple(r) for r in T.tokenised(frame, TOKENIZER).collect()), key=lambda r: r[1]) == brute(docs)
    assert T.tokenised(frame.limit(0), TOKENIZER).count() == 0


def test_whole_table_and_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    folder = new_folder(spark, "tokens")
    T.write_tokens(docs, folder, TOKENIZER)
    assert sorted((tuple(r) for r in T.token_index(spark, folder).collect()), key=lambda r: r[1]) == want
    one = T.read_tokens(spark, folder).where(F.col("doc_id") == 17)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    assert [len(r.ids) for r in one.collect()] == [r[2] for r in want if r[0] == 17]


def test_pieces_of_one_value():
    """Two words whose letters follow the Thue-Morse sequence have one 64-bit value, whatever its odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    data = np.frombuffer((one + two).encode(), np.uint8)
    values = T.run_values(data, np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))
    assert values[0] == values[1]
    texts = [one, two, f"x {two}", f"x {one} y"]
    assert encoded(T.Encoder(TOKENIZER), texts) == plain(texts)
    assert encoded(T.Encoder(TOKENIZER), texts[::-1]) == plain(texts[::-1])


def test_memo_compares_bytes(monkeypatch):
    """Even if all pieces had one value."""
    monkeypatch.setattr(T, "run_values", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    texts = ["some words of a text, and a very-long-piece-0123456789 of it", "other words. a very-long-piece-0123456788", "a", ""]
    assert encoded(T.Encoder(TOKENIZER), texts) == plain(texts)


def test_other_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, own = T.Encoder(path), Tokenizer.from_file(path)
    assert ENCODER.by_pieces and not encoder.by_pieces
    texts = ["Some words, of a Text.", "", "a  b\nc"]
    assert encoded(encoder, texts) == [[*own.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_start_of_repeated_and_null_ids(spark):
    """What lies at `start` in the files is the row's own text."""
    docs = [(5, "one two three four five six seven"), (5, "a"), (5, "some more words"), (5, "a"), (None, "none"), (None, "none at all"), (4, "before"), (6, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    folder = new_folder(spark, "tokens")
    T.write_tokens(frame, folder, TOKENIZER)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    flat = [i for row in T.read_tokens(spark, folder).select("ids", number.alias("n"), "place").orderBy("n", "place").collect() for i in row.ids]
    index = T.token_index(spark, folder).collect()
    assert [r.doc_id for r in sorted(index, key=lambda r: r.start)] == [None, None, 4, 5, 5, 5, 5, 6]
    found = sorted(((r.doc_id, flat[r.start : r.start + r.n_tokens]) for r in index), key=str)
    assert found == sorted(((d, ids) for (d, t), ids in zip(docs, plain([t or "" for _, t in docs]), strict=True)), key=str)
    assert all(zlib.crc32(np.array(flat[r.start : r.start + r.n_tokens], dtype="<u4").tobytes()) == r.ids_crc32 for r in index)
