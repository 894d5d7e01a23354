"""Near-duplicate groups by SimHash and ball hashing that meets in the middle.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of a text's word shingles, repeats
included. Two fingerprints at most `radius` bits apart share a variant at most radius/2 bits from either, so every
distinct fingerprint emits its ball of that size, the variants are shuffled, and each variant's fingerprints (at most
as many as the ball has members, whatever the data) are linked to the least of them after a check of their distance.
The links of one variant are a star over a clique, so no connection is lost. Groups are connected components.

near_duplicates() is that, exactly, at a small radius. similar_groups() looks for texts of a given similarity of word
shingles. Their candidates come from the same fingerprints and balls, and an exact check follows; texts of that similarity whose
fingerprints are further apart than a ball can reach are candidates where they agree in a band of least hashes. Either way
sketches of all least hashes must not be too unlike, and a link is kept only if the Jaccard similarity of the two sets of
shingles, compared word by word, is at least the one asked for.

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any other; a text of fewer
words than a shingle has one shingle, all its words; equal texts always share a group; rows without a doc_id link others like
any row, and a component's id is null only where no row of it has an id; similar_groups() tells texts apart by themselves, whatever their ids; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from turnloom.llm.components import connected
from turnloom.llm.rows import packed_row
from turnloom.llm.tokens_np import strings
from turnloom.session import written

SHINGLE = 3
RADIUS = 2
_SEED = 42
_PART = 1 << 16


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the values, as a signed number."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _PART):
        counts += np.unpackbits(hashes[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.lower().split()
    return _majority(_hashes(b" ".join(words), words, shingle)) if words else 0


def _hashes(line: bytes, words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a line of words, repeats included."""
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    return np.array([xxh64_intdigest(line[a:b], _SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = strings(batch.column("text"))
            whole = data.tobytes()
            prints = [fingerprint(whole[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print, a signed 64-bit fingerprint, for every row."""
    source = documents.select("doc_id", "text")
    return source.mapInArrow(_fingerprints(shingle), f"doc_id {dict(source.dtypes)['doc_id']}, print long")


def _ball(half: int) -> list[int]:
    """Masks of at most `half` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _variants(nodes: DataFrame, radius: int) -> DataFrame:
    """(print, variant) for the members of each print's ball."""
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(radius // 2)])
    return nodes.select("print", F.explode(masks).alias("mask")).select("print", F.expr("print ^ mask").alias("variant"))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct prints, b the least of a's variant group; enough for all connections."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4: half of it is the size of each ball")
    spread = _variants(nodes, radius)
    met = spread.withColumn("least", F.min("print").over(Window.partitionBy("variant"))).where("print != least")
    return met.where(F.bit_count(F.expr("print ^ least")) <= radius).select(F.col("print").alias("a"), F.col("least").alias("b")).distinct()


def ball_buckets(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, bucket) of nodes (node, print): two whose prints are at most `radius` bits apart have a variant as a bucket in common."""
    prints = written(nodes.groupBy("print").agg(F.count("*").alias("n_nodes")), "simhash-prints")
    met = _variants(prints, radius).withColumn("n", F.count("*").over(Window.partitionBy("variant"))).where("n > 1").select("print", "variant")
    own = prints.where("n_nodes > 1").select("print", F.col("print").alias("variant"))
    of = written(met.unionByName(own).distinct().withColumnRenamed("print", "of"), "simhash-variants")
    return nodes.join(of, F.col("print") == F.col("of")).select("node", F.xxhash64("variant", F.lit("ball")).alias("bucket"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, print, component_id (the least doc_id that links reach)."""
    return components(written(fingerprints(documents, shingle), "simhash"), radius)


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, print) with component_id, the least doc_id of all rows whose prints links reach."""
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    labels = connected(links(nodes, radius))  # without the least node of each group
    # Most prints have no link and are their own group; the others' groups are few rows beside them.
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    grouped = nodes.join(labels, nodes.print == labels.node)
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = written(grouped.select("node", F.col("label").alias("of")).join(least, F.col("of") == F.col("label")).select("node", "component_id"), "simhash-linked")
    named = nodes.join(linked, nodes.print == linked.node, "left")
    named = named.select(F.col("print").alias("of"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    named = written(named, "simhash-components")
    return prints.join(named, prints.print == named.of, "left").select("doc_id", "print", "component_id")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of near_duplicates()."""
    return result.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# -- similar texts -----------------------------------------------------------------------------------------------------

WIDE = 4
#: A pair of similarity s agrees in a band with odds s**ROWS, and in any of them with 1 - (1 - s**ROWS)**BANDS: 0.97 at 0.8.
BANDS, ROWS = 32, 10
#: The number of members of a bucket that others are compared with grows by this factor each turn, from one to all.
GROWTH = 8
#: A bucket with more members outside its largest component is dealt again by rare shingles instead of comparing them all.
CROWD = 128
_SALTS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048
_ROWS_AT_ONCE = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Up to so many pairs, nodes or buckets (200 bytes each at most), and lines or ids of up to so many bytes in all, are sent
#: to where the other rows are; more are joined by a shuffle. The rows are the same.
MOST_PAIRS, MOST_LINES = 200_000, 16 << 20


def most_bits(similarity: float) -> int:
    """Of 64 * WIDE bits at most so many differ, on average, between texts whose shingle sets have this Jaccard similarity.

    Sets of equal size have cosine 2s / (1 + s), and a bit differs with the share that their angle has of half a turn.
    """
    return round(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _line(text: bytes) -> bytes:
    """A text's words, lower-cased (A-Z), with single blanks between."""
    return b" ".join(text.lower().split())


def shingles(line: bytes, shingle: int) -> list[bytes]:
    """The shingles of a text's words; one of all words where they are fewer."""
    words = line.split(b" ")
    return [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]


def least_hashes(line: bytes, shingle: int) -> np.ndarray:
    """The least values of BANDS * ROWS orders of the distinct shingles."""
    return _least(_hashes(line, line.split(b" "), shingle))


def _least(hashes: np.ndarray) -> np.ndarray:
    hashes = np.unique(hashes).astype(np.uint64)
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (_SALTS[:, None] * hashes[None, i : i + _CHUNK]).min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """BANDS values, each of ROWS of the least hashes."""
    data, size = least.tobytes(), 8 * ROWS
    return [int(np.uint64(xxh64_intdigest(data[i * size : (i + 1) * size], i)).astype(np.int64)) for i in range(BANDS)]


def sketch(least: np.ndarray) -> list[int]:
    """Four bits of each of the least hashes: all first bits, all second bits and so on, in signed 64-bit numbers."""
    bits = (least * _MIX >> np.uint64(60)).astype(np.uint8)
    return np.concatenate([np.packbits(bits >> k & 1) for k in range(4)]).view(np.int64).tolist()


def most_unlike(similarity: float) -> int:
    """So many of the sketches' four-bit values may differ: four standard deviations over the mean at this similarity.

    Values of equal least hashes agree, of others one in 16. Of the pairs of just this similarity 1 in 30,000 differs in more.
    """
    odds = (1 - similarity) * 15 / 16
    return math.ceil(BANDS * ROWS * odds + 4 * math.sqrt(BANDS * ROWS * odds * (1 - odds)))


def _unlike(a: str, b: str) -> Column:
    """The number of four-bit values in which two sketches differ."""
    n = BANDS * ROWS // 64
    unlike = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(4 * n)]
    return reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, unlike[i::n])) for i in range(n)])


def _lines(column: pa.Array) -> list[bytes]:
    at, data = strings(column)
    whole = data[at[0] : at[-1]].tobytes()
    at -= at[0]
    return [_line(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of _ROWS_AT_ONCE, so that a worker holds little beside the batch itself."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(i, _ROWS_AT_ONCE)


def _node(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def _banded(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lines = _lines(batch.column("text"))
            hashes = [_hashes(x, x.split(b" "), shingle) for x in lines]
            prints = pa.array([_majority(h) if x else 0 for x, h in zip(lines, hashes, strict=True)], pa.int64())
            least = [_least(h) for h in hashes]
            values, sketches = (pa.array(map(f, least), pa.list_(pa.int64())) for f in (bands, sketch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_node, lines), pa.binary()), prints, values, sketches], ["doc_id", "node", "print", "bands", "sketch"])

    return run


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_node, _lines(batch.column("text"))), pa.binary())], [*batch.schema.names, "node"])


def _compared(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Neighbouring rows share a line on one of the sides.
        known = lru_cache(maxsize=2)(lambda line: frozenset(shingles(line, shingle)))
        for batch in _slices(batches):
            good = []
            for x, y in zip(batch.column("few_line").to_pylist(), batch.column("many_line").to_pylist(), strict=True):
                few, many = known(x), known(y)
                both = len(few & many)
                good.append(both >= similarity * (len(few) + len(many) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        lines = _lines(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, lines), pa.binary()), pa.array(lines, pa.binary())], ["node", "line"])


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers or nodes, sent to all executors where they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_PAIRS else rows


def _judged(pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) with `good`; of the columns few and many, the nodes of a pair, few has the fewer different ones."""
    side = lambda name: lines.select(F.col("node").alias(name), F.col("line").alias(f"{name}_line"))
    few = side("few").join(pairs.select("few").distinct(), "few", "left_semi")
    light = pairs.count() <= MOST_PAIRS
    short = light and few.agg(F.coalesce(F.sum(F.octet_length("few_line")), F.lit(0))).first()[0] <= MOST_LINES
    both = side("many").join(F.broadcast(pairs) if light else pairs, "many").join(F.broadcast(few) if short else side("few"), "few")
    return both.select("a", "b", "few_line", "many_line").mapInArrow(_compared(shingle, similarity), "a binary, b binary, good boolean")


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link, from the labels before and the links (a, b) found since."""
    return connected(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _tokens(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, line in zip(batch.column("node").to_pylist(), batch.column("line").to_pylist(), strict=True):
                values = np.unique(np.array([xxh64_intdigest(x, _SEED) for x in set(shingles(line, shingle))], dtype=np.uint64)).view(np.int64)
                for i in range(0, len(values), _PART):
                    part = pa.array(values[i : i + _PART])
                    yield pa.RecordBatch.from_arrays([pa.array([node] * len(part), pa.binary()), part, pa.array(np.full(len(part), len(values)))], ["node", "token", "size"])

    return run


def _rare_buckets(crowd: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(bucket, node) of the nodes of a crowd, by their rarest shingles: each pair that is similar enough has a bucket in common.

    Shingles are ordered by the number of the crowd's texts that have them, then by value. Of two sets of at least this
    Jaccard similarity s, each has at least s times its size in common with the other, so the first shingle in common is
    among the size - ceil(s * size) + 1 first ones of both. A passage that many texts share comes last in the order, so
    texts that have nothing else in common don't meet. A shingle of one text alone is no bucket.
    """
    tokens = lines.join(_sent(crowd.select(F.col("node").alias("of"))), F.col("node") == F.col("of"), "left_semi").select("node", "line").mapInArrow(_tokens(shingle), "node binary, token long, size long")
    tokens = written(tokens, "similar-tokens")
    common = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "similar-common")
    placed = tokens.join(_sent(common), "token", "left")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "token"))
    first = placed.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1)
    return first.where("n is not null").select(F.col("token").alias("bucket"), "node")


def _settled(entries: DataFrame, labels: DataFrame | None, lines: DataFrame, shingle: int, similarity: float, crowd: int | None) -> tuple[DataFrame | None, list[DataFrame]]:
    """The labels (node, label) that links within the buckets of entries (bucket, node, label, sketch) lead to.

    Buckets that after the first turn have more than `crowd` members outside their largest component are left; their nodes come back too.
    A node's place is the same in all buckets and turns, so the members chosen in a turn are chosen in the later ones too. The turns in
    which a member was outside and chosen (bits of outs and choices) tell which pairs of a bucket were compared before.
    """
    turn, left = 0, []
    place = F.xxhash64("node", F.lit(0))
    entries = entries.withColumns({"outs": F.lit(0), "choices": F.lit(0)})
    while True:
        sizes = entries.groupBy("bucket", "label").agg(F.count("*").alias("of_label"), F.min(F.struct(place.alias("place"), "node")).alias("first"))
        most = F.max(F.struct("of_label", "label"))
        buckets = sizes.groupBy("bucket").agg(F.sum("of_label").alias("n"), F.min("first").alias("first"), most["label"].alias("largest"), most["of_label"].alias("most"), F.count("*").alias("n_labels"))
        buckets = written(buckets.where("n_labels > 1").drop("n_labels"), "similar-open")
        if turn and crowd is not None:
            crowded = buckets.where(F.col("n") - F.col("most") > crowd).select("bucket")
            nodes = written(entries.join(_sent(crowded), "bucket", "left_semi").select("node").distinct(), "similar-crowd")
            if nodes.limit(1).count():
                left.append(nodes)
                buckets = buckets.where(F.col("n") - F.col("most") <= crowd)
        if not buckets.limit(1).count():
            return labels, left
        share = F.lit(float(GROWTH**turn)) / F.col("n")
        last = share >= 1 if turn else F.col("n") <= 2
        chosen = (F.col("node") == F.col("first.node")) | last | (F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
        outside = F.col("label") != F.col("largest") if turn else F.lit(True)
        rows = entries.join(_sent(buckets), "bucket").select("bucket", "node", "label", "sketch", F.col("first.node").alias("first"), last.alias("last"), chosen.alias("chosen"), outside.alias("outside"), "outs", "choices")
        if turn:
            of_node = Window.partitionBy("node")
            rows = rows.withColumns({f"{name}_in": F.collect_list(F.when(F.col(name), F.col("bucket"))).over(of_node) for name in ("outside", "chosen")})
        rows = written(rows, "similar-rows")
        if turn:
            some = rows.where("chosen").select("bucket", *[F.col(c).alias("other" if c == "node" else f"other_{c}") for c in rows.columns if c not in ("bucket", "first", "last")])
            fresh = "label != other_label and outs & other_choices = 0 and other_outs & choices = 0"
            # Two that share several buckets, or would meet each other both ways, meet once: in the least such bucket of one way.
            once = "array_min(array_intersect(outside_in, other_chosen_in)) = bucket and (node < other or not arrays_overlap(other_outside_in, chosen_in))"
            met = rows.where("outside").join(_sent(some), "bucket").where(F.expr(fresh) & (_unlike("sketch", "other_sketch") <= most_unlike(similarity)) & F.expr(once))
        else:
            # A node and the first of its buckets share many of them: each such pair is formed once.
            pair = rows.where("node != first").groupBy("node", F.col("first").alias("other")).agg(F.first("label").alias("label"), F.first("sketch").alias("sketch"))
            firsts = rows.where("node = first").groupBy(F.col("node").alias("of")).agg(F.first("label").alias("other_label"), F.first("sketch").alias("other_sketch"))
            met = pair.join(_sent(written(firsts, "similar-firsts")), F.col("other") == F.col("of")).where("label != other_label")
            met = met.where(_unlike("sketch", "other_sketch") <= most_unlike(similarity))
        # At first few members are met by many others, later few are left that meet many.
        pair = met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"), F.col("node" if turn else "other").alias("few"))
        pairs = pair.groupBy("a", "b").agg(F.min("few").alias("few")).withColumn("many", F.when(F.col("few") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        pairs = written(pairs, "similar-candidates")
        judged = written(_judged(pairs, lines, shingle, similarity).where("good").select("a", "b"), "similar-links")
        labels = _grown(labels, judged)
        # The first turn compares with the first member alone.
        seen = {"outs": F.col("outside"), "choices": F.col("chosen") if turn else F.col("node") == F.col("first")}
        kept = rows.where("not last").withColumns({c: F.col(c).bitwiseOR(now.cast("int") * (1 << turn)) for c, now in seen.items()})
        entries = _relabelled(kept.select("bucket", "node", "sketch", *seen), labels)
        turn += 1


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node, sketch and others) with their node's label."""
    named = rows.join(_sent(labels.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left")
    return written(named.select(*rows.columns, F.coalesce("label", "node").alias("label")), "similar-entries")


def similar_labels(prints: DataFrame, documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, label) of every node that has a link: components of the pairs that share a bucket and are that similar.

    Buckets are the variants of fingerprints, in which all within RADIUS bits meet, and the bands of least hashes.

    At first all members of a bucket are compared with one of them, the same one in all buckets that have it. A bucket
    whose members are by then in one component is done. In the others, the members outside the bucket's largest component
    are compared with a growing share of the members of other components, at last with all of them. So no pair of
    one component is compared for nothing, a pair that shares several buckets is formed in one of them, a bucket forms no pair in
    two turns, and a bucket is done only when its members are in one component or all its pairs
    between components have been compared: no link between components is lost. To be compared word by word, two
    sketches may differ in no more than most_unlike() says.

    Where more than CROWD members are outside a bucket's largest component, comparing all of them would grow with the
    square of the bucket. Such buckets' members are dealt again into buckets of their rarest shingles, in which every pair
    of that similarity meets, and settled in the same way.
    """
    distinct = written(prints.groupBy("node").agg(F.first("print").alias("print"), F.first("bands").alias("bands")), "similar-distinct")
    banded = distinct.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    members = written(ball_buckets(distinct.select("node", "print")).unionByName(banded), "similar-members")
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "similar-buckets")
    live = written(members.join(_sent(shared), "bucket").select("bucket", "node"), "similar-live")
    wanted = _sent(written(live.select(F.col("node").alias("of")).distinct(), "similar-wanted"))
    sketches = prints.select("node", "sketch").join(wanted, F.col("node") == F.col("of"), "left_semi")
    sketches = sketches.groupBy("node").agg(F.first("sketch").alias("sketch"))
    entries = written(live.join(sketches, "node").select("bucket", "node", F.col("node").alias("label"), "sketch"), "similar-entries")
    lines = documents.select("text").mapInArrow(_words_of, "node binary, line binary")
    lines = written(lines.join(wanted, F.col("node") == F.col("of"), "left_semi").groupBy("node").agg(F.first("line").alias("line")), "similar-lines")
    labels, left = _settled(entries, None, lines, shingle, similarity, CROWD)
    if labels is None:
        return _grown(None, entries.limit(0).selectExpr("node as a", "label as b"))
    if left:
        buckets = written(_rare_buckets(reduce(DataFrame.unionByName, left).distinct(), lines, shingle, similarity), "similar-rare")
        again = buckets.join(_sent(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")), "bucket", "left_semi")
        sketches = prints.join(_sent(again.select(F.col("node").alias("of")).distinct()), F.col("node") == F.col("of"), "left_semi").groupBy(F.col("node").alias("of")).agg(F.first("sketch").alias("sketch"))
        entries = _relabelled(again.join(sketches, F.col("node") == F.col("of")).select("bucket", "node", "sketch"), labels)
        labels, _ = _settled(entries, labels, lines, shingle, similarity, None)
    return labels


def _labelled(documents: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and node of every row, and the label of every node that has links."""
    source = documents.select("doc_id", "text")
    prints = written(source.mapInArrow(_banded(shingle), f"doc_id {dict(source.dtypes)['doc_id']}, node binary, print long, bands array<long>, sketch array<long>"), "similar-bands")
    labels = similar_labels(prints, documents, shingle, similarity)
    return prints.select("doc_id", "node"), labels.select(F.col("node").alias("of"), "label")


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, node (what its words hash to), group, and component_id (the group's least doc_id).

    Groups are connected by links of at least this similarity of shingle sets.
    """
    prints, labels = _labelled(documents, shingle, similarity)
    rows = written(prints.join(labels, F.col("node") == F.col("of"), "left").select("doc_id", "node", F.coalesce("label", "node").alias("group")), "similar-named")
    least = written(rows.groupBy("group").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("group", "of"), "similar-components")
    return rows.join(least, F.col("group") == F.col("of")).select("doc_id", "node", "group", "component_id")


def representatives(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without similar ones: one row of each group stays, that of the least doc_id (null last)."""
    groups = written(similar_groups(documents, shingle, similarity), "simhash-groups")
    if not groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        gone = written(groups.where("doc_id != component_id").select(F.col("doc_id").alias("of")), "simhash-gone")
        if gone.agg(F.coalesce(F.sum(F.octet_length(F.col("of").cast("string")) + 16), F.lit(0))).first()[0] <= MOST_LINES:
            gone = F.broadcast(gone)
        packed = documents.select(packed_row(documents), "doc_id")
        return packed.join(gone, F.col("doc_id") == F.col("of"), "left_anti").select("row.*")
    # Ids that are null or repeat can't tell rows apart: rows are told apart by their words and text instead, which
    # gives the same rows where ids do tell them apart.
    packed = documents.select(packed_row(documents), "text")
    shape = T.StructType([*packed.schema.fields, T.StructField("node", T.BinaryType())])
    group = groups.select(F.col("node").alias("of_node"), "group").distinct()
    rank = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    rows = packed.mapInArrow(_with_nodes, shape).join(group, F.col("node") == F.col("of_node")).withColumn("rank", rank)
    best = rows.groupBy("group").agg(F.min("rank").alias("best")).withColumnRenamed("group", "of")
    kept = rows.join(best, (F.col("group") == F.col("of")) & F.col("rank").eqNullSafe(F.col("best")))
    return kept.dropDuplicates(["group"]).select("row.*")
