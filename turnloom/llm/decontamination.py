"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A benchmark item's windows
are its runs of `span` words; an item of fewer words is one window, an item without words has none. Of each window's
k-grams the one of least hash (the last of equals) is its fingerprint, so a span shared by an item and a document has
the same fingerprint on both sides and none is missed. Document fingerprints that the benchmark also has are extended
to the whole windows around them, and the windows' words are compared in an exact join.

Defined results: null and empty texts have no words and no hits; rows with the same or a null doc_id are separate
documents; repeated benchmark rows with one item_id count once; a null item_id counts as the item "null"; other columns
of either table are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.rows import packed_row
from turnloom.llm.tokens_np import ALNUM, Piece, grams, mixed, pieces, whole_runs
from turnloom.session import written

SPAN = 10
GRAM = 5
#: Benchmark fingerprints up to this many (8 bytes each, 16 MB) go to the tasks as an array; more are joined by a shuffle.
MOST_SENT = 2_000_000
#: Hashes of contaminated texts up to this many (about 100 bytes each) are sent to all executors; more are joined by a shuffle.
MOST_LEAKS = 200_000
_FILTER_BITS = 20


def _fingerprints(piece: Piece, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of `length` words, and the position and hash of the fingerprint of each."""
    k = min(GRAM, length)
    hashes = mixed(grams(words, k) + np.uint64(length))
    whole = np.flatnonzero(whole_runs(piece, length))
    n = len(words) - length + 1
    if not len(whole):
        return whole, whole, np.zeros(0, np.uint64)
    best, at = hashes[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, length - k + 1):
        other = hashes[j : j + n]
        less = other <= best
        best[less], at[less] = other[less], j
    return whole, whole + at[whole], best[whole]


def _benchmark_windows(lengths_short_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            items, lengths, texts, prints = [], [], [], []
            for piece in pieces(batch.column("text"), ALNUM, lower=True):
                words = piece.hashes()
                counts = np.diff(piece.words)
                for length in np.unique(np.minimum(counts, lengths_short_of)):
                    if not length:
                        continue
                    owner = piece.owner()
                    for i, _, h in zip(*_fingerprints(piece, words, int(length)), strict=True):
                        if min(counts[owner[i]], lengths_short_of) == length:
                            items.append(ids[piece.rows[0] + owner[i]])
                            lengths.append(int(length))
                            texts.append(piece.word(i, i + int(length)))
                            prints.append(int(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(lengths, pa.int32()), pa.array(texts, pa.string()), pa.array(prints, pa.int64())], ["item", "length", "window", "print"])

    return run


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each distinct window of each item: item, length, window (its words), print (its fingerprint)."""
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return source.mapInArrow(_benchmark_windows(span), "item string, length int, window string, print long").distinct()


class _Known:
    """Membership in a sorted array of fingerprints, with a bit table before the search."""

    def __init__(self, prints: np.ndarray):
        self.prints = np.unique(prints.astype(np.uint64))
        self.table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.table[self.prints >> np.uint64(64 - _FILTER_BITS)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table[hashes >> np.uint64(64 - _FILTER_BITS)]
        some = np.flatnonzero(found)
        if len(some):
            found[some] = np.isin(hashes[some], self.prints)
        return found


def _distinct_positions(where: np.ndarray) -> np.ndarray:
    """Indices of the first of each run of equal positions."""
    keep = np.ones(len(where), dtype=bool)
    keep[1:] = where[1:] != where[:-1]
    return np.flatnonzero(keep)


def _document_hits(lengths: list[int], prints: np.ndarray | None):
    """Rows of documents with the windows around fingerprints that are known: all of `prints`, or the row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(prints) if prints is not None else None
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            own = batch.column("prints").to_pylist() if known is None else None
            for piece in pieces(batch.column("text"), ALNUM, lower=True):
                lo, hi = piece.rows
                n_words[lo:hi] = np.diff(piece.words)
                words, owner = piece.hashes(), piece.owner()
                here = known or _Known(np.array([p for x in own[lo:hi] for p in x or ()], dtype=np.int64))
                for length in lengths:
                    starts, where, hashes = _fingerprints(piece, words, length)
                    if not len(starts):
                        continue
                    once = _distinct_positions(where)
                    good = where[once][here.has(hashes[once])]
                    for i in starts[np.isin(where, good)] if len(good) else ():
                        d = owner[i]
                        hits[lo + d].append({"start": int(i - piece.words[d]), "length": length, "window": piece.word(i, i + length)})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("window", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    return run


def _document_prints(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in pieces(batch.column("text"), ALNUM, lower=True):
                words, owner = piece.hashes(), piece.owner()
                for length in lengths:
                    starts, where, hashes = _fingerprints(piece, words, length)
                    once = _distinct_positions(where)
                    rows = pa.array(piece.rows[0] + owner[starts[once]])
                    yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(hashes[once].astype(np.int64))], ["doc_id", "print"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside windows of items), items (sorted ids), spans (start, end)."""
    windows = written(benchmark_windows(benchmark, span), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `span` numbers
    known = windows.select("print").distinct()
    source = documents.select("doc_id", "text")
    shape = f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, hits array<struct<start: long, length: int, window: string>>"
    if known.count() <= most_sent:
        prints = known.toArrow()["print"].to_numpy()
        found = source.mapInArrow(_document_hits(lengths, prints), shape)
    else:
        # Ids may be null or repeat; equal texts have equal fingerprints, so rows meet theirs by the text.
        named = source.withColumn("key", F.sha2("text", 256))
        own = named.select(F.col("key").alias("doc_id"), "text").mapInArrow(_document_prints(lengths), "doc_id string, print long")
        matched = own.join(known, "print", "left_semi").groupBy("doc_id").agg(F.collect_set("print").alias("prints")).withColumnRenamed("doc_id", "of")
        joined = named.join(matched, F.col("key") == F.col("of"), "left").drop("of", "key")
        found = joined.mapInArrow(_document_hits(lengths, None), shape)
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "document-hits")
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    # Windows of one item set are one thing to a document: it meets each set once, however many windows and places it has.
    shared = windows.groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256))
    shared = written(shared, "benchmark-sets")
    sets = shared.select(F.col("set").alias("of"), "items").dropDuplicates(["of"])
    places = hits.join(shared.select("length", "window", "set"), ["length", "window"])
    met = places.select("row", "set").distinct().join(sets, F.col("set") == F.col("of"))
    items = met.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = (
        places.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.upto))).alias("n"), F.greatest(a.upto, s.end).alias("upto")),
    ).n
    none = F.array().cast("array<string>")
    return (
        rows.drop("hits").join(items, "row", "left").join(spans, "row", "left")
        .select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, most_sent: int = MOST_SENT) -> DataFrame:
    """The documents without any window of an item, with all their columns."""
    # Ids may be null or repeat, and the text alone decides: rows are told apart by it.
    named = documents.select(F.sha2("text", 256).alias("doc_id"), "text")
    found = contamination(named, benchmark, span, most_sent).where("n_hit > 0").select(F.col("doc_id").alias("leak")).distinct()
    leaks = written(found, "contaminated")
    packed = documents.select(packed_row(documents), F.sha2("text", 256).alias("key"))
    few = leaks.count() <= MOST_LEAKS
    return packed.join(F.broadcast(leaks) if few else leaks, F.col("key") == F.col("leak"), "left_anti").select("row.*")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of contamination()."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle_sql(span: int = SPAN) -> str:
    """The digest's rows in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as ws from documents),
b as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as ws from benchmark),
spans as (select item, ws, least({span}, len(ws)) as n from b where len(ws) > 0),
windows as (select distinct item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as w from (select *, unnest(generate_series(1, len(ws) - n + 1)) as i from spans)),
lengths as (select distinct n from windows),
places as (select r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as w from (select r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, lengths where len(ws) >= n)),
hits as (select r, i, n, item from places join windows using (n, w)),
words as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(i, i + n - 1)) as p from hits) group by r),
found as (select r, count(*) as n_items, array_to_string(list(item order by item), ',') as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join found using (r)"""
