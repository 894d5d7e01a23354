"""op12 against plain slicing of Python strings."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm import fill_middle as M


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, len(text), form, None if form == "plain" else a, None if form == "plain" else b - a, out, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé€𝄞 \n\0<P>"), max_size=30), max_size=8))
def test_units(texts):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    units = M.Units(data)
    whole = "".join(texts)
    at = np.cumsum([0, *map(len, parts)])
    assert units.before(at).tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    assert units.end(np.arange(len(whole) + 1)).tolist() == [len(whole[:k].encode()) for k in range(len(whole) + 1)]


def test_texts(spark):
    texts = ["", None, "a", "é", "𝄞" * 9, "has <M> a mark", "<P", "<<S", "ends in <", "\0" * 8, "x" * 4_000_000 + "é", " ", *("ab€𝄞" * (n // 3) + "z" * n for n in range(60))]
    docs = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "no id"), (None, None), (7, "again"), (7, "again")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, output string, n int").repartition(3)
    got = M.transformed(frame).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(plain(*d) for d in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.transformed(frame.limit(0)).count() == 0


def test_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((*w[:5], sha(w[5]), sha(w[6])) for w in (plain(r.doc_id, r.text) for r in docs.collect()))
    assert sorted(map(tuple, M.digest(M.transformed(docs)).collect())) == want
