"""Token ids in ORC files.

Texts are range-partitioned and sorted by doc_id, encoded, and written as ORC: integer run-length encoded ids, row
indexes, and Bloom filters on doc_id, so that readers take stripes in parallel and skip those without their ids. Files
follow each other in the order of doc_id; each document's ids end with `end_id`.

Encoding: texts are cut at borders where the tokenizer's own splitting cuts anyway, and each distinct piece goes through
the tokenizer once for each worker, as long as its bounded memo lasts. Pieces are looked up by 64-bit values and then
compared byte by byte; a piece that only has the value of another is encoded by itself. A tokenizer file that does not
split like a byte-level one encodes whole texts.

Defined results: null and empty texts have the end id alone; doc_ids are numbers (others end in a cast error); null
doc_ids come first; rows with equal doc_ids follow each other, and each one's `start` is its own place in the files;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.tokens_np import run_values, strings
from turnloom.session import new_folder, written

END_ID = 0
#: Pieces, and ids in them, that a worker remembers at most before it starts anew.
MOST_PIECES = 1_500_000
_SLICE = 1 << 20
_SLOTS = 22
_CALL = 2_000
_SPACE, _LINE = 0x20, 0x0A


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Byte-level vocabularies name bytes by characters: visible ones by themselves, the rest by those from U+0100 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = np.arange(256, dtype="<u4")
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_NAMES[_HIDDEN] = np.arange(len(_HIDDEN)) + 0x100
_BYTE_NAMES[_LINE] = _LINE  # never in a word; it parts them
_LETTER = _bytes((0x41, 0x5A), (0x61, 0x7A))
_SEEN = _bytes((0x21, 0x7E))
#: Bytes that begin a character which is no white space; C2, E1, E2 and E3 may begin some.
_SEEN_NEXT = _bytes((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
_MARK = _bytes((0x2C, 0x2C), (0x2E, 0x2E))


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are of ASCII or Latin-1 letters (those of C3 and a second byte but the two signs among them)."""
    out = _LETTER[data]
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    out[two] = out[two + 1] = True
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text and where the tokenizer's own splitting has a border whatever else the text has.

    Borders are before a space that a visible character follows, between a letter (ASCII or Latin-1) and a comma or full
    stop, and between a line feed and a letter if the line feed stands alone after a visible character.
    """
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        here, next_, last, before = data[1:-1], data[2:], data[:-2], data
        cut[1:-1] = (here == _SPACE) & _SEEN_NEXT[next_]
        latin = np.zeros(len(here), dtype=bool)
        latin[1:] = (before[: len(here) - 1] == 0xC3) & (last[1:] != 0x97) & (last[1:] != 0xB7) & (last[1:] >= 0x80)
        cut[1:-1] |= _MARK[here] & (_LETTER[last] | latin)
        alone = (data[1:-1] == _LINE) & _SEEN[data[:-2]] & _LETTER[data[2:]]
        cut[2:] |= alone
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    # a border looks at the bytes around it, which must be of one text
    ends = bounds[1:-1]
    for shift in (-1, 1):
        near = ends + shift
        near = near[(near >= 0) & (near < len(data))]
        cut[near[~np.isin(near, bounds)]] = False
    return np.flatnonzero(cut)


def _edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each run as numbers; a shorter run has all its bytes in the first."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    sizes = np.minimum(ends - starts, 8)
    short = sizes < 8
    first, last = eight[starts] & _LOWEST[sizes], eight[np.maximum(ends - 8, 0)]
    last[short] = 0
    return first, last


_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _cuts_like_pieces(tokenizer) -> bool:
    """Whether a tokenizer splits texts like a byte-level one, so that piece_starts() are borders of its own."""
    told = json.loads(tokenizer.to_str())
    split, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = not told.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    whole = all(not any(c.isspace() or c in ",." for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in told.get("added_tokens", ()))
    return plain and whole and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)


class _Memo:
    """Pieces and their ids, looked up by value and compared by bytes."""

    def __init__(self) -> None:
        none = lambda kind: np.zeros(0, dtype=kind)
        self.keys, self.first, self.last = none(np.uint64), none(np.uint64), none(np.uint64)
        self.sizes, self.starts, self.lengths, self.flat = none(np.int32), none(np.int32), none(np.int32), none(np.int32)
        self.long: dict[int, bytes] = {}
        #: Most keys are found by their top bits; those whose slot was taken are in a sorted array.
        self.slots = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.other_keys, self.other_at = none(np.uint64), none(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        at = self.slots[keys >> np.uint64(64 - _SLOTS)]
        if not len(self.keys):
            return at
        missed = np.flatnonzero((at < 0) | (self.keys[at] != keys))
        at[missed] = -1
        if len(missed) and len(self.other_keys):
            place = np.minimum(np.searchsorted(self.other_keys, keys[missed]), len(self.other_keys) - 1)
            good = self.other_keys[place] == keys[missed]
            at[missed[good]] = self.other_at[place[good]]
        return at

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: list[list[int]]) -> None:
        """Remembers pieces with new and distinct keys."""
        at = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        slots = keys >> np.uint64(64 - _SLOTS)
        free = self.slots[slots] < 0
        self.slots[slots[free]] = at[free]
        lost = self.slots[slots] != at
        if lost.any():
            order = np.argsort(keys[lost])
            where = np.searchsorted(self.other_keys, keys[lost][order])
            self.other_keys, self.other_at = np.insert(self.other_keys, where, keys[lost][order]), np.insert(self.other_at, where, at[lost][order])
        first, last = _edges(data, starts, ends)
        for i in np.flatnonzero(ends - starts > 16).tolist():
            self.long[int(at[i])] = data[starts[i] : ends[i]].tobytes()
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        new = {
            "keys": keys, "first": first, "last": last, "sizes": (ends - starts).astype(np.int32), "lengths": lengths,
            "starts": (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32),
            "flat": np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum())),
        }
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def same(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the pieces at these places have just these bytes."""
        first, last = _edges(data, starts, ends)
        out = (self.sizes[at] == ends - starts) & (self.first[at] == first) & (self.last[at] == last)
        for i in np.flatnonzero(out & (ends - starts > 16)).tolist():
            out[i] = self.long[int(at[i])] == data[starts[i] : ends[i]].tobytes()
        return out


class Encoder:
    """Encodes texts by pieces with a memo: each distinct piece goes through the tokenizer once."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _cuts_like_pieces(self.tokenizer)
        self.end_id = end_id
        self.memo = _Memo()

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """The ids of each piece. A run of letters is one word for the tokenizer's model; the rest goes its whole way."""
        pieces = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        other = np.concatenate(([0], np.cumsum(~letters(data), dtype=np.int32)))
        first = starts + (data[starts] == _SPACE)
        words = (ends > first) & (other[ends] == other[first])
        ids: list[list[int]] = [[]] * len(pieces)
        plain = np.flatnonzero(words).tolist()
        raw = np.frombuffer(b"\n".join([pieces[i] for i in plain]), np.uint8)
        tokenize = self.tokenizer.model.tokenize
        for i, name in zip(plain, _BYTE_NAMES[raw].tobytes().decode("utf-32-le").split("\n"), strict=False):
            ids[i] = [t.id for t in tokenize(name)]
        rest = np.flatnonzero(~words).tolist()
        for i, found in zip(rest, self.whole([pieces[i] for i in rest]), strict=True):
            ids[i] = found
        return ids

    def whole(self, texts: list[bytes]) -> Iterator[list[int]]:
        """The ids of texts that go the tokenizer's whole way."""
        for at in range(0, len(texts), _CALL):
            some = [t.decode("utf-8", "replace") for t in texts[at : at + _CALL]]
            yield from (found.ids for found in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))

    def _by_pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts without the end id, and the texts' offsets in them."""
        if max(len(self.memo.keys), len(self.memo.flat) // 4) > MOST_PIECES:
            self.memo = _Memo()
        starts = piece_starts(data, bounds)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        keys = run_values(data, starts, ends)
        at = self.memo.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            firsts = new[np.unique(keys[new], return_index=True)[1]]
            self.memo.add(keys[firsts], data, starts[firsts], ends[firsts], self.tokens(data, starts[firsts], ends[firsts]))
            at[new] = self.memo.find(keys[new])
        lengths, sources, flat = self.memo.lengths[at], self.memo.starts[at], self.memo.flat
        odd = np.flatnonzero(~self.memo.same(at, data, starts, ends))
        if len(odd):
            ids = self.tokens(data, starts[odd], ends[odd])
            lengths[odd] = [len(x) for x in ids]
            sources[odd] = len(flat) + np.cumsum(lengths[odd]) - lengths[odd]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), dtype=np.int32)])
        upto = np.cumsum(lengths, dtype=np.int64)
        values = flat[np.repeat(sources - (upto - lengths), lengths) + np.arange(int(upto[-1]))]
        return values, np.concatenate(([0], upto))[np.searchsorted(starts, bounds)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end in `data`, each with the end id behind, and the texts' offsets in the ids."""
        if self.by_pieces:
            values, per_text = self._by_pieces(data, bounds)
        else:
            ids = list(self.whole([data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]))
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
            per_text = np.cumsum([0, *map(len, ids)])
        values = np.insert(values, per_text[1:], np.int32(self.end_id))
        return values, (per_text + np.arange(len(bounds))).astype(np.int32)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((path, end_id), None) or Encoder(path, end_id)
        _ENCODERS[path, end_id] = encoder  # a worker's later tasks go on with its memo
        place = 0
        for batch in batches:
            at, data = strings(batch.column("text"))
            first = 0
            while first < batch.num_rows:
                last = min(batch.num_rows, max(first + 1, int(np.searchsorted(at, at[first] + _SLICE, "right")) - 1))
                values, offsets = encoder.encode(data[at[first] : at[last]], at[first : last + 1] - at[first])
                places = pa.array(np.arange(place, place + last - first))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), places, pa.ListArray.from_arrays(offsets, values)], ["doc_id", "place", "ids"])
                place, first = place + last - first, last

    return run


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, stripe_bytes: int = 32 << 20) -> None:
    """Writes doc_id, place (number of the row in its part) and ids of every document in ascending order of doc_id.

    Rows of one doc_id, or of none, are ordered and dealt by a hash of their text, so that many of them take many parts.
    """
    source = documents.select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(_encode(tokenizer, end_id), f"doc_id {dict(source.dtypes)['doc_id']}, place long, ids array<int>")
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(stripe_bytes))
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, place and ids as stored; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema("doc_id long, place long, ids array<int>").orc(folder)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in spans]
        named = [batch.column(c) for c in ("doc_id", "part", "place")]
        yield pa.RecordBatch.from_arrays([*named, pa.array([b - a for a, b in spans], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids before the document), n_tokens, ids_crc32 (ids as little-endian 32-bit).

    Sums run in the order of places within each part and over the parts' totals: one row for each part, not for each
    document.
    """
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")  # parts are numbered in the order of their ranges
    stored = read_tokens(spark, folder).select("doc_id", "place", "ids", number.alias("part"))
    rows = written(stored.mapInArrow(_checksums, "doc_id long, part long, place long, n_tokens long, ids_crc32 long"), "token-index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(starts, placed.part == starts.of).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenised(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' tokens below the shared folder and returns the index read from the files."""
    spark = documents.sparkSession
    folder = new_folder(spark, "tokens")
    write_tokens(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folder, tokenizer, end_id)
    return token_index(spark, folder)
