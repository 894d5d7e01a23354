"""Fill-in-the-middle texts: a text is cut in three and written as prefix, suffix, middle, with a mark before each part.

Where a cut stands is counted in code points. The UTF-8 bytes of many texts are viewed as 64-bit words; each byte that ends
a code point (the byte behind it is no continuation) gets a mark by shifts and masks of whole words, the marks of a word are
counted by one bit count, the word that holds a wanted code point is searched in the running counts, and the byte within
the word is found from the marks' prefix sums, which one multiplication gives.

Forms: `plain` (the text as it is), `psm` (prefix, suffix, middle) and `spm` (suffix, prefix, middle). A text that is empty or
contains a mark is plain, so every other form can be taken apart again.

Defined results: a null text is empty; a null doc_id draws like the empty string; equal rows give equal rows; other
columns are ignored. The draws depend on seed and doc_id alone, so a rerun gives the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.tokens_np import PIECE_BYTES, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of all texts that may be cut, and percent of the cut ones that put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
SEED = "1"
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class Units:
    """Where the code points of some UTF-8 bytes end."""

    def __init__(self, data: np.ndarray):
        size = len(data) // 8 + 1
        padded = np.zeros(8 * (size + 1), dtype=np.uint8)
        padded[: len(data)] = data
        word = padded.view("<u8")
        start = _LOW ^ (word >> np.uint64(7) & ~(word >> np.uint64(6)) & _LOW)
        self.marks = start[:-1] >> np.uint64(8) | start[1:] << np.uint64(56)
        self.marks[-1] &= np.uint64((1 << 8 * (len(data) % 8)) - 1)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)))

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many code points end before each byte."""
        word, inside = at // 8, (at % 8).astype(np.uint64)
        below = self.marks[word] & ((np.uint64(1) << np.uint64(8) * inside) - np.uint64(1))
        return self.counts[word] + np.bitwise_count(below)

    def end(self, unit: np.ndarray) -> np.ndarray:
        """The byte behind each code point, counted from 1; 0 for none."""
        word = np.maximum(np.searchsorted(self.counts, unit, "left") - 1, 0)
        rank = (unit - self.counts[word]).astype(np.uint64)
        reached = (self.marks[word] * _LOW | _HIGH) - rank * _LOW & _HIGH
        return np.where(unit > 0, 8 * word + 9 - np.bitwise_count(reached).astype(np.int64), 0)


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_BYTES together, or one longer text."""
    first = 0
    while first < len(at) - 1:
        last = min(len(at) - 1, max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1))
        yield first, last
        first = last


def _transformed(marks: tuple[bytes, bytes, bytes]):
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = strings(batch.column("text"))
            draws = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
            forms = batch.column("form").to_pylist()
            for first, last in _pieces(at):
                part, bound = data[at[first] : at[last]], at[first : last + 1] - at[first]
                units = Units(part)
                before = units.before(bound)
                n = np.diff(before)
                one, two = (h[first:last] % (n + 1) for h in draws)
                left, right = np.minimum(one, two), np.maximum(one, two)
                a, b = (np.where(cut > 0, units.end(before[:-1] + cut), bound[:-1]) for cut in (left, right))
                whole, out = part.tobytes(), []
                for form, i, j, k, end in zip(forms[first:last], bound[:-1].tolist(), a.tolist(), b.tolist(), bound[1:].tolist(), strict=True):
                    prefix, middle, suffix = whole[i:j], whole[j:k], whole[k:end]
                    out.append(whole[i:end] if form == "plain" else b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
                plain = np.array([form == "plain" for form in forms[first:last]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), batch.column("form").slice(first, last - first),
                        pa.array(left, pa.int64(), mask=plain), pa.array(right - left, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def transformed(documents: DataFrame, seed: str = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars and middle_chars (null if plain), output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | text.contains(mark)
    form = F.when((text == "") | marked | (draw[2] % 100 >= cut), "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = documents.select("doc_id", text.alias("text"), draw[0].alias("h1"), draw[1].alias("h2"), form.alias("form"))
    shape = f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transformed(tuple(x.encode() for x in marks)), shape)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was cut, from the output and its form alone."""
    part = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    whole = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of transformed()."""
    text = restored(F.col("output"), F.col("form"))
    return result.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def oracle_sql() -> str:
    return """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS two,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cuts AS (
  SELECT doc_id, t, n, form, least(one, two) AS a, greatest(one, two) AS b FROM numbers
), parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
