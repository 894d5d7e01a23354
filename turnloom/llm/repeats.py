"""Substring dedup with prefix-partitioned suffix trees.

Every start of `span` words in a document is a suffix. Documents are dealt into parts of about PART_BYTES by a hash of
the row, and three steps run over the parts, which all read one shuffle of the texts:

1. Which suffixes can be shared: each part sends the distinct 64-bit values of its suffixes' first `span` words, less
   their top bits, to groups by those top bits, and learns which of them other parts or documents have too. Two different
   beginnings of one value only make a suffix look shared; none that is shared is missed.
2. Trees: suffixes that may be shared go, with their words, to groups by prefix. The prefix is read at the suffix's
   anchor, where among its first `span` words the 4 words of least hash begin, so that neighbouring suffixes, which
   mostly have one anchor, travel as one stretch of about 3 words each and not of 13. A census of all suffixes tells
   which prefixes have more than a group's worth; these are split by prefixes of 8 words and then of `span`. A part
   sends equal suffixes once, for its least document, so a prefix of `span` words has at most one suffix of each part
   and can't be heavy. A group sorts its suffixes by their words; neighbours that agree in `span` words are leaves of
   one internal node of that depth, which is where the tree is cut: what lies deeper splits nodes that are repeats
   already. Of a node, the leaves of greater documents than its least are repeats. The order comes from that of the words
   by doubling: runs of 2, 4 and 8 words are ordered by the places of their halves.
3. Each part removes what the nodes and its own comparison name. Neighbouring repeats join to maximal ones (`spans`).

Words are compared in steps 2 and 3, so no two different sequences are taken for one. A part's rows for the groups are
parts times groups in number, and never more than there are stretches.

Defined results: null, empty and short texts have nothing to remove; doc_ids are numbers (others end in a cast error);
equal doc_ids never remove from each other; a null doc_id counts as greater than all ids, so rows without an id don't
remove from each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.tokens_np import VISIBLE, grams, mixed, pieces, whole_runs
from turnloom.session import small_batches

SPAN = 13
#: About so many bytes of text make a part, and so many suffixes at most a group. A worker holds some ten times a part's
#: bytes, or 50 bytes for each word of a group.
PART_BYTES = 8 << 20
GROUP = 1 << 19
#: Bins of the census, at each length of prefixes, for each group.
_BINS_A_GROUP = 16
_NULL_ID = np.iinfo(np.int64).max


def levels(span: int) -> list[int]:
    """Lengths of prefixes."""
    return sorted({min(4, span), min(8, span), span})


def _anchors(words: np.ndarray, at: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at some places, where the words of least hash begin, and a value of these words."""
    hashes = mixed(grams(words, length) + np.uint64(length))
    best, place = hashes[at], at.copy()
    for j in range(1, span - length + 1):
        other = hashes[at + j]
        less = np.flatnonzero(other < best)
        best[less], place[less] = other[less], at[less] + j
    return place, mixed(best)


# -- the census of prefixes --------------------------------------------------------------------------------------------


def _census(span: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(levels(span)), 1 << bits), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch.column("text"), VISIBLE):
                words, at = piece.hashes(), np.flatnonzero(whole_runs(piece, span))
                if len(at):
                    for level, length in enumerate(levels(span)):
                        values = _anchors(words, at, length, span)[1]
                        total[level] += np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        level, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(place), pa.array(total[level, place])], ["level", "bin", "n"])

    return run


class Prefixes:
    """Which group each suffix belongs to, by the shortest prefix whose bin is not too heavy."""

    def __init__(self, counts: np.ndarray, group: int):
        """counts: suffixes by level and bin; a bin of the last level is never split."""
        self.bits = counts.shape[1].bit_length() - 1
        self.groups, self.of = 0, []
        heavy = np.ones(counts.shape[1], dtype=bool)
        for level, row in enumerate(counts):
            heavy = (row > group) if level + 1 < len(counts) else np.zeros(len(row), dtype=bool)
            packed = np.cumsum(np.where(heavy, 0, row)) // group
            self.of.append(np.where(heavy, -1, self.groups + packed).astype(np.int32))
            self.groups += int(packed[-1]) + 1
            if not heavy.any():
                break

    def groups_of(self, words: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Group and anchor of the suffixes at some places."""
        groups, anchors, left = np.full(len(at), -1, dtype=np.int32), at.copy(), np.arange(len(at))
        for table, length in zip(self.of, levels(span), strict=False):
            anchors[left], values = _anchors(words, at[left], length, span)
            groups[left] = table[(values >> np.uint64(64 - self.bits)).astype(np.int64)]
            left = left[groups[left] < 0]
            if not len(left):
                break
        return groups, anchors


# -- parts of documents ------------------------------------------------------------------------------------------------


def _named(data: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """Numbers of words, equal for equal words only; word i and one blank are data[cuts[i]:cuts[i + 1]]."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()


def _classes(values: np.ndarray, data: np.ndarray, cuts: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the suffixes at some places, equal if and only if their first `span` words are; values: the suffixes' values."""
    order = np.argsort(values[at], kind="stable")
    own = at[order]
    new = np.concatenate(([True], np.diff(values[own]) != 0))[: len(own)]
    label, least = np.cumsum(new) - 1, own[new]
    several = np.flatnonzero(~(new & np.append(new[1:], True)[: len(own)]))
    if len(several):  # words of one value may be different
        own, least = own[several], least[label[several]]
        edges = np.zeros(len(cuts), dtype=np.int32)
        np.add.at(edges, own, 1)
        np.add.at(edges, own + span, -1)
        inside = np.cumsum(edges[:-1], dtype=np.int32) > 0
        sizes = np.diff(cuts)
        names = np.zeros(len(inside), dtype=np.int32)
        names[inside] = _named(data[np.repeat(inside, sizes)], np.concatenate(([0], np.cumsum(sizes[inside])))).indices.to_numpy()
        wrong = np.zeros(len(own), dtype=bool)
        for j in range(span):
            wrong |= names[own + j] != names[least + j]
        if wrong.any():
            some = np.isin(label[several], label[several[wrong]])
            _, inverse = np.unique(np.stack([names[own[some] + j] for j in range(span)], axis=1), axis=0, return_inverse=True)
            label[several[some]] = label[-1] + 1 + inverse.ravel()
    out = np.empty(len(at), dtype=np.int64)
    out[order] = label
    return out


class _Part:
    """The documents of a part in the order of ids: their words' values, and the values of whole suffixes.

    With `texts`, also the words, each with one blank behind it; memory is a small multiple of the part's size whatever is shared.
    """

    def __init__(self, table: pa.Table, span: int, texts: bool = True):
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.span, self.ids = span, table.column("doc_id").combine_chunks().take(order)
        self.ranks = self.ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        column = table.column("text").combine_chunks().take(order)
        hashes, sizes, counts, data = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for piece in pieces(column, VISIBLE):
            hashes.append(piece.hashes())
            counts.append(np.diff(piece.words))
            if texts:
                sizes.append(piece.ends - piece.starts + 1)
                line = np.full(sizes[-1].sum(), 32, dtype=np.uint8)
                inside = np.ones(len(line), dtype=bool)
                inside[np.cumsum(sizes[-1]) - 1] = False
                line[inside] = piece.data[VISIBLE[piece.data]]
                data.append(line)
        del column
        self.words = np.concatenate(hashes)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        if texts:
            self.data, self.cuts = np.concatenate(data), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        del hashes, sizes, data
        self.paths = grams(self.words, span)
        of = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        self.owner = of[: len(self.paths)]
        self.whole = np.flatnonzero(self.owner == of[span - 1 :]) if len(self.paths) else np.zeros(0, np.int64)

    def classes(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes at some places, equal if and only if their first `span` words are."""
        return _classes(self.paths, self.data, self.cuts, at, self.span)

    def stretches(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words `first` to `last` - 1 with single blanks between, for each pair."""
        data = self.data.tobytes()
        return [data[a : b - 1] for a, b in zip(self.cuts[first].tolist(), self.cuts[last].tolist(), strict=True)]

    def among(self, values: np.ndarray, shift: int) -> np.ndarray:
        """Places of whole suffixes whose path value, without its last `shift` bits, is one of the values."""
        if not len(values):
            return self.whole[:0]
        known = np.sort(values, kind="stable")  # mostly in runs that are sorted
        own = self.paths[self.whole] >> np.uint64(shift)
        table = np.zeros(1 << 20, dtype=bool)
        table[known & np.uint64((1 << 20) - 1)] = True
        some = np.flatnonzero(table[own & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(known, own[some]), len(known) - 1)
        return self.whole[some[known[place] == own[some]]]


def _pieces_by(key: np.ndarray) -> list[np.ndarray]:
    """Indices of equal keys, for each key."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte of all, so that compression finds the small ones' zeros."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


_VALUES = "part long, top long, several boolean, paths binary"


def _sent_values(span: int, bits: int):
    """Step 1: the distinct path values of a part, by their top bits; `several` are those of more than one id."""

    def run(table: pa.Table) -> pa.Table:
        number, part = table.column("part")[0].as_py(), _Part(table, span, texts=False)
        paths, ranks = part.paths[part.whole], part.ranks[part.owner[part.whole]]
        order = np.argsort(paths, kind="stable")  # documents stay in the order of ids
        paths, ranks = paths[order], ranks[order]
        heads = np.flatnonzero(np.concatenate(([True], paths[1:] != paths[:-1]))) if len(paths) else np.zeros(0, np.int64)
        several = ranks[np.append(heads[1:], len(paths)) - 1] != ranks[heads] if len(heads) else np.zeros(0, bool)
        values, rows = paths[heads], []
        for flag in (False, True):
            own = values[several == flag]
            top = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            low = (own << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(top)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(top)], strict=True):
                if b > a:
                    rows.append((number, int(top[a]), flag, _packed(low[a:b])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["part", "top", "several", "paths"])

    return run


def _shared_values(table: pa.Table) -> pa.Table:
    """For each part of a group, the values that may be shared."""
    blobs = [_unpacked(x) for x in table.column("paths").to_pylist()]
    sizes = np.array([len(b) for b in blobs])
    _, which, n = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[which[np.repeat(table.column("several").to_numpy(), sizes)]] = True
    marked = np.split(shared[which], np.cumsum(sizes)[:-1])
    out = [(part, _packed(blob[own])) for part, blob, own in zip(table.column("part").to_pylist(), blobs, marked, strict=True) if own.any()]
    top = table.column("top")[0].as_py()
    return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([top] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["part", "top", "paths"])


_LEAVES = "group int, part long, words binary, docs binary, refs binary"


def _spans(places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that windows at some places (ascending) cover."""
    heads = np.flatnonzero(np.concatenate(([True], np.diff(places) > span))[: len(places)])
    return places[heads], places[np.append(heads[1:], len(places))[: len(heads)] - 1] + span


def _leaves(span: int, bits: int, prefixes: Prefixes):
    """Step 2, on the side of the parts: suffixes that may be shared, by group, and repeats that the part knows itself."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return pa.Table.from_batches([], pa.schema([("group", pa.int32()), ("part", pa.int64()), ("words", pa.binary()), ("docs", pa.binary()), ("refs", pa.binary())]))
        number, part = table.column("part")[0].as_py(), _Part(table, span)
        tops = shared.column("top").to_numpy().astype(np.uint64)
        values = [_unpacked(b).astype(np.uint64) | t << np.uint64(32) for b, t in zip(shared.column("paths").to_pylist(), tops, strict=True)]
        at = part.among(np.concatenate(values), 32 - bits)
        label = part.classes(at)
        least = np.zeros(label.max(initial=-1) + 1, dtype=np.int64)
        least[label[::-1]] = at[::-1]  # the first place of each class stays
        least, owner = part.owner[least][label], part.owner[at]
        known = np.stack(_spans(at[part.ranks[least] < part.ranks[owner]], span), axis=1)
        at = at[least == owner]
        del label, least, owner
        groups, anchors = prefixes.groups_of(part.words, at, span)
        # neighbours of one anchor and group are one stretch
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchors) != 0) | (np.diff(groups) != 0)))) if len(at) else at
        first, last, groups = at[heads], at[np.append(heads[1:], len(at)) - 1] if len(at) else at, groups[heads]
        owner = part.owner[first]
        stretches = part.stretches(first, last + span)
        rows, docs = [], part.ranks[owner]
        for own in _pieces_by(groups):
            rows.append((int(groups[own[0]]), number, b"\n".join([stretches[i] for i in own.tolist()]), docs[own].tobytes(), first[own].astype(np.int32).tobytes()))
        if len(known):
            rows.append((number % prefixes.groups, number, None, None, known.astype(np.int32).tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["group", "part", "words", "docs", "refs"])

    return run


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Equal keys' common place in their order."""
    order = np.argsort(keys)
    keys = keys[order]
    out = np.empty(len(keys), dtype=np.int32)
    out[order] = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))[: len(keys)])
    return out


def sorted_suffixes(data: np.ndarray, cuts: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The place of each suffix in the order of their first `span` words, one for equal ones; word i and one blank are
    data[cuts[i]:cuts[i + 1]]. Words are sorted first, then runs of 2, 4, ... words by the places of their halves."""
    names = _named(data, cuts)
    ranks = np.empty(len(names.dictionary), dtype=np.int32)
    ranks[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(ranks), dtype=np.int32)
    ranks, length = ranks[names.indices.to_numpy()], 1
    while 2 * length <= span:
        keys = ranks.astype(np.int64) << 32
        keys[:-length] |= ranks[length:]
        ranks, length = _ranked(keys), 2 * length
    return _ranked(ranks[at].astype(np.int64) << 32 | ranks[at + span - length])


def repeated_leaves(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which suffixes are leaves of a node whose least document is a smaller one; a node's suffixes have one rank."""
    least = np.full(ranks.max(initial=-1) + 1, _NULL_ID)
    np.minimum.at(least, ranks, docs)
    return docs > least[ranks]


def _suffixes(stretches: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches (one a line): their words, each with one blank behind it, where these are cut, the places of suffixes
    that have `span` words, and how many each stretch gives."""
    data = np.frombuffer(stretches + b"\n", np.uint8).copy()
    gaps = np.flatnonzero((data == 32) | (data == 10))
    new = data[gaps] == 10
    line = np.cumsum(new, dtype=np.int32) - new
    data[gaps] = 32
    at = np.flatnonzero(line[: max(0, len(line) - span + 1)] == line[span - 1 :])
    return data, np.concatenate(([0], gaps + 1)), at, np.bincount(line[at], minlength=line[-1] + 1)


def _windows(stretches: bytes, span: int) -> tuple[list[bytes], np.ndarray]:
    """The first `span` words of each suffix of the stretches that has so many, and how many each gives."""
    data, cuts, at, sizes = _suffixes(stretches, span)
    return [data[a : b - 1].tobytes() for a, b in zip(cuts[at].tolist(), cuts[at + span].tolist(), strict=True)], sizes


def _subtree(table: pa.Table, span: int) -> pa.Table:
    """Step 2, in a group: for each part the places of repeats, as runs; spans that parts know themselves pass through."""
    parts, refs, out = table.column("part").to_pylist(), table.column("refs").to_pylist(), []
    words = table.column("words").to_pylist()
    sent = [i for i, w in enumerate(words) if w is not None]
    if sent:
        data, cuts, at, sizes = _suffixes(b"\n".join(words[i] for i in sent), span)
        docs = np.concatenate([np.frombuffer(table.column("docs")[i].as_py(), np.int64) for i in sent])
        first = np.concatenate([np.frombuffer(refs[i], np.int32) for i in sent])
        of = np.repeat(np.arange(len(sent)), [len(refs[i]) // 4 for i in sent])  # the row of each stretch
        own = np.flatnonzero(repeated_leaves(sorted_suffixes(data, cuts, at, span), np.repeat(docs, sizes)))
        before = np.cumsum(sizes) - sizes
        stretch = np.searchsorted(before, own, "right") - 1
        places, row = first[stretch] + (own - before[stretch]), of[stretch]
        if len(own):
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(places) != 1) | (np.diff(row) != 0))))
            runs = np.stack([places[heads], np.diff(np.append(heads, len(places)))], axis=1).astype(np.int32)
            cut = np.flatnonzero(np.diff(row[heads])) + 1
            out += [(parts[sent[k]], False, some.tobytes()) for k, some in zip(row[heads[np.append(0, cut)]].tolist(), np.split(runs, cut), strict=True)]
    out += [(parts[i], True, refs[i]) for i, w in enumerate(words) if w is None]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["part", "covered", "refs"])


def _kept(span: int, texts: bool):
    """Step 3: the documents of a part without repeats."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        part = _Part(table, span)
        change = np.zeros(len(part.words) + 1, dtype=np.int32)
        places = [np.zeros(0, np.int64)]
        for covered, blob in zip(found.column("covered").to_pylist(), found.column("refs").to_pylist(), strict=True):
            values = np.frombuffer(blob, np.int32).astype(np.int64)
            if covered:
                np.add.at(change, values[::2], 1)
                np.add.at(change, values[1::2], -1)
            else:
                starts, sizes = values[::2], values[1::2]
                places.append(np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))
        named = np.sort(np.concatenate(places))
        at = part.among(part.paths[named], 0)
        label = part.classes(at)
        gone = np.zeros(label.max(initial=-1) + 1, dtype=bool)
        gone[label[np.searchsorted(at, named)]] = True
        hit = at[gone[label]]
        change[hit] += 1
        change[hit + span] -= 1
        del at, label, hit
        covered = np.cumsum(change[:-1]) > 0
        n_removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[part.first])
        stays = part.data[np.repeat(~covered, np.diff(part.cuts))]
        ends = np.concatenate(([0], np.cumsum(np.where(covered, 0, np.diff(part.cuts)))))[part.first].tolist()
        out, spans = [], []
        for document in range(len(part.first) - 1):
            own = covered[part.first[document] : part.first[document + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))) if n_removed[document] else np.zeros(0, np.int64)
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            text = stays[ends[document] : max(ends[document], ends[document + 1] - 1)].tobytes()
            out.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([part.ids, pa.array(np.diff(part.first)), pa.array(n_removed), pa.array(out, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def without_repeats(documents: DataFrame, span: int = SPAN, part_bytes: int = PART_BYTES, group: int = GROUP, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the text that stays, or its SHA-256, with single spaces)
    and spans (start and end, in words, of each maximal stretch of repeats)."""
    small_batches(documents.sparkSession)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions, size // part_bytes) | 1
    likely = size // 6  # words of usual length
    bits = max(0, min(likely // group, likely // (250 * parts), 1 << 24).bit_length())
    least = max(1000, min(group, likely // partitions))
    bins = max(12, (_BINS_A_GROUP * (likely // group)).bit_length())
    counts = np.zeros((len(levels(span)), 1 << bins), dtype=np.int64)
    census = source.select("text").mapInArrow(_census(span, bins), "level long, bin long, n long").groupBy("level", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[census.column("level").to_numpy(), census.column("bin").to_numpy()] = census.column("n").to_numpy()
    prefixes = Prefixes(counts, least)
    dealt = source.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    shared = dealt.groupBy("part").applyInArrow(_sent_values(span, bits), _VALUES).groupBy("top").applyInArrow(_shared_values, "part long, top long, paths binary")
    trees = lambda table: _subtree(table, span)
    leaves = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_leaves(span, bits, prefixes), _LEAVES)
    found = leaves.groupBy("group").applyInArrow(trees, "part long, covered boolean, refs binary")
    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_kept(span, texts), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents."""
    return without_repeats(documents, texts=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def oracle_sql(span: int = SPAN) -> str:
    """The digest's rows in DuckDB."""
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
places as (select r, doc_id, i, array_to_string(list_slice(ws, i, i + {span - 1}), ' ') as w from (select *, unnest(generate_series(1, len(ws) - {span - 1})) as i from d where len(ws) >= {span})),
least_ids as (select w, min(doc_id) as first from places group by w),
gone as (select r, list(distinct p) as ps from (select r, unnest(generate_series(i, i + {span - 1})) as p from places join least_ids using (w) where first < coalesce(doc_id, first + 1)) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end, ' '), '')) as kept_sha256
from d left join gone using (r)"""
