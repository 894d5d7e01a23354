"""Exact top-k search by inner product, a block of rows at a time.

Rows are ordered so that neighbours are alike and cut into ranges, ranges into blocks. A block has its vectors (the
forward index) and the largest and least value of each of its terms, a term being a component. A query's bound for a
block is the sum, over terms, of its weight times the term's largest value (least, where the weight is negative): no row
of the block scores more. Blocks are scored in descending order of the bound until it falls below the k-th best score so
far, or equals it and the block has no smaller id. That is exact; the order of rows only decides how much is skipped.

The work runs over batches of queries. A batch has at most QUERY_BYTES of vectors, is sent to all executors and meets every
range of the index where that lies: nothing of the index is shuffled. First the terms' bounds of the ranges alone are read
for the best range of each query; that range is scored, which gives each query its first k-th score; then all other
ranges are scored under it. Only the hits, k for each query and range at most, are shuffled.

Rows are ordered by the number of components, their two nearest pivots and id. The pivots are at most PIVOTS rows, those of
least hash, of PIVOT_BYTES together: a bounded sample that, again, only decides how much is skipped.

Defined results: vectors that are null or hold null, NaN or infinite components are neither queries nor found; components
that a shorter vector lacks count as zero; an empty vector scores zero with all; rows are told apart by themselves, so a
query finds other rows of its own id, and rows that repeat are each found and each asked for; among equal scores a smaller
id comes first, a null id last; a null id is no query; scores beyond a long count as the nearest long; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import new_folder, written

SCALE = 1024
BLOCK, RANGE = 32, 1024
RANGE_BYTES = 4 << 20
PIVOTS, PIVOT_BYTES = 256, 1 << 20
QUERY_BYTES = 16 << 20
_AT_ONCE = 256
_LAST = np.iinfo(np.int64).max
_EXACT = 2.0**53


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id (vec_id) and vector, floor(scale * component), of the rows whose vectors are sound."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Whole numbers as doubles: exact for any float, however large.
    whole = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("id"), whole.alias("vector"))


def _floor(x: Column) -> Column:
    """floor() that stays a double: Spark's own gives a long, which large values leave."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _pivots(rows: DataFrame) -> np.ndarray:
    """At most PIVOTS different vectors, in columns, filled up with zeros to one length."""
    chosen = rows.select("vector", "row").where(F.size("vector") > 0).orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("vector")
    kept, used = {}, 0
    for (vector,) in chosen.where(F.size("vector") * 8 <= PIVOT_BYTES).collect():
        if tuple(vector) not in kept and used + 8 * len(vector) <= PIVOT_BYTES:
            kept[tuple(vector)], used = vector, used + 8 * len(vector)
    out = np.zeros((max(map(len, kept.values()), default=1), max(1, len(kept))))
    for i, vector in enumerate(kept.values()):
        out[: len(vector), i] = vector
    return out


def _near(pivots: np.ndarray):
    """Adds the two nearest pivots of each row, or of its leading components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=0) / 2
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            first, second = np.zeros((2, len(sizes)), dtype=np.int32)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                use = min(dim, len(pivots))
                part = _matrix(batch.column("vector").take(pa.array(at)), dim)[:, :use]
                with np.errstate(over="ignore", invalid="ignore"):
                    far = half - part @ pivots[:use]
                best = np.argpartition(far, min(1, far.shape[1] - 1), axis=1)[:, :2]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1), 1)
                first[at], second[at] = best[:, 0], best[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(first), pa.array(second)], [*batch.schema.names, "dim", "near", "next"])

    return run


def _packed(matrix: np.ndarray) -> bytes:
    """The numbers in the smallest of three types, with the type's letter in front."""
    most = np.abs(matrix).max(initial=0)
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + matrix.astype(kind).tobytes()


def _unpacked(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=data[:1].decode(), offset=1).reshape(rows, dim).astype(np.float64)


def _ranges(block: int, most_rows: int):
    """Sorted rows as ranges of one number of components; what is left of a batch waits for the next."""
    shape = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vectors", "largest", "least", "top", "low"))])

    def packed(part: pa.Table, dim: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        matrix = _matrix(part.column("vector").chunk(0), dim)
        starts = np.arange(0, len(matrix), block)
        largest, least = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        values = [dim, block, part.column("id").to_pylist(), part.column("row").to_pylist(), *map(_packed, (matrix, largest, least, largest.max(axis=0, keepdims=True), least.min(axis=0, keepdims=True)))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, shape.types, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            held = yield from full(held, last=False)
        if held is not None:
            yield from full(held, last=True)

    def full(held: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        while held.num_rows:
            dim = held.column("dim")[0].as_py()
            most = max(1, min(most_rows, RANGE_BYTES // (8 * max(1, dim))))
            same = int((held.column("dim").slice(0, most).to_numpy() == dim).sum())
            if same < most and same == held.num_rows and not last:
                break
            yield packed(held.slice(0, same), dim)
            held = held.slice(same)
        return held

    return run


def index(rows: DataFrame, block: int = BLOCK, most_rows: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, ranges) of a result of quantised(); both are written to the shared folder."""
    spark = rows.sparkSession
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "search-rows")
    near = numbered.mapInArrow(_near(_pivots(numbered)), "id long, vector array<double>, row long, dim int, near int, next int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "near", "next", F.col("id").asc_nulls_last(), "row"]
    dealt = written(near, "search-near").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shape = "dim int, block int, ids array<long>, rows array<long>, vectors binary, largest binary, least binary, top binary, low binary"
    ranges = dealt.mapInArrow(_ranges(block, most_rows), shape).withColumn("range", F.monotonically_increasing_id())
    return numbered, written(ranges, "search-index")


class Batch:
    """Some queries: their rows, vectors by number of components, and what is known of each: score and id of the k-th."""

    def __init__(self, table: pa.Table):
        self.rows = table.column("row").to_numpy()
        sizes = pa.compute.list_value_length(table.column("vector")).to_numpy()
        column = table.column("vector").combine_chunks()
        self.groups = [(int(dim), at, _matrix(column.take(pa.array(at)), int(dim))) for dim in np.unique(sizes) for at in [np.flatnonzero(sizes == dim)]]
        self.home = np.full(len(self.rows), -1, dtype=np.int64)
        self.score, self.id = np.full(len(self.rows), -_LAST - 1), np.full(len(self.rows), _LAST)

    def against(self, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, vectors cut or filled up with zeros to dim components), some queries at a time."""
        for own, at, vectors in self.groups:
            for i in range(0, len(at), _AT_ONCE):
                part = vectors[i : i + _AT_ONCE, :dim]
                yield at[i : i + _AT_ONCE], part if own >= dim else np.pad(part, ((0, 0), (0, dim - own)))


def _bounds(query: np.ndarray, largest: np.ndarray, least: np.ndarray) -> np.ndarray:
    return np.maximum(query, 0) @ largest.T + np.minimum(query, 0) @ least.T


def _exact(dim: int, *parts: np.ndarray) -> list[np.ndarray]:
    """The same numbers in a type whose sums of products are exact: doubles, or else Python's numbers."""
    most = math.prod(max(1.0, float(np.abs(p).max(initial=0))) for p in parts[:2])
    if dim * most < _EXACT:
        return list(parts)
    return [np.vectorize(int, otypes=[object])(p) if p.size else p.astype(object) for p in parts]


def _as_long(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -_LAST - 1, _LAST) if scores.dtype == object else scores


def _homes(batch: Broadcast):
    """For each query the range with the best bound among those that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Batch = batch.value
        best, home = np.full(len(known.rows), -np.inf), np.full(len(known.rows), -1, dtype=np.int64)
        for rows in batches:
            for number, dim, top, low in zip(*(rows.column(c).to_pylist() for c in ("range", "dim", "top", "low")), strict=True):
                largest, least = _unpacked(top, dim, 1), _unpacked(low, dim, 1)
                for at, query in known.against(dim):
                    bound = _bounds(query, largest, least)[:, 0]
                    better = (bound > best[at]) | (home[at] < 0)
                    best[at[better]], home[at[better]] = bound[better], number
        at = np.flatnonzero(home >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(best[at]), pa.array(home[at])], ["at", "bound", "home"])

    return run


def _scored(batch: Broadcast, k: int, at_home: bool):
    """The k best rows of each range for each query, as far as its k-th score does not rule them out.

    Of a query's ranges its home is scored if at_home, and all others if not.
    """

    def of_range(known: Batch, number: int, dim: int, size: int, ids: np.ndarray, rows: np.ndarray, forward: np.ndarray, largest: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        starts = np.arange(0, len(forward), size)
        first_id = np.minimum.reduceat(ids, starts)
        padding = -len(forward) % size
        blocks = np.pad(forward, ((0, padding), (0, 0))).reshape(len(starts), size, dim)
        ids, rows = (np.pad(x, (0, padding), constant_values=v).reshape(-1, size) for x, v in ((ids, _LAST), (rows, -1)))
        for at, query in known.against(dim):
            chosen = (known.home[at] == number) == at_home
            at, query = at[chosen], query[chosen]
            if not len(at):
                continue
            query, data, largest_, least_ = _exact(dim, query, blocks, largest, least)
            bounds = _as_long(_bounds(query, largest_, least_))
            order = np.argsort(-bounds, axis=1, kind="stable")
            score, name, row = np.full((len(at), k), -np.inf, dtype=query.dtype), np.full((len(at), k), _LAST), np.full((len(at), k), -1)
            # What the k-th has to beat: the one known before, or the one of this range if that is better.
            limit, limit_id = known.score[at].astype(query.dtype), known.id[at].copy()
            live = np.arange(len(at))
            for step in range(len(starts)):
                block = order[live, step]
                bound = bounds[live, block]
                # Bounds only fall: a query is done when one is below its limit; at its limit, smaller ids can still win.
                live, block, bound = (x[bound >= limit[live]] for x in (live, block, bound))
                wanted = (bound > limit[live]) | (first_id[block] <= limit_id[live])
                now, block = live[wanted], block[wanted]
                if not len(live):
                    break
                if not len(now):
                    continue
                new = _as_long((data[block] @ query[now][:, :, None])[:, :, 0])
                new_row = rows[block]
                none = (new_row < 0) | (new_row == known.rows[at[now]][:, None])
                new = np.where(none, -np.inf, new)
                all_score, all_id, all_row = (np.concatenate(x, axis=1) for x in ((score[now], new), (name[now], ids[block]), (row[now], np.where(none, -1, new_row))))
                best = np.lexsort((all_row < 0, all_id, -all_score), axis=1)[:, :k] if all_score.dtype != object else np.array([sorted(range(len(s)), key=lambda i: (-s[i], j[i], r[i] < 0))[:k] for s, j, r in zip(all_score, all_id, all_row, strict=True)])  # noqa: B023
                score[now], name[now], row[now] = (np.take_along_axis(x, best, 1) for x in (all_score, all_id, all_row))
                full = now[row[now, -1] >= 0]
                raised = (score[full, -1] > limit[full]) | (score[full, -1] == limit[full]) & (name[full, -1] < limit_id[full])
                full = full[raised]
                limit[full], limit_id[full] = score[full, -1], name[full, -1]
            found = (row >= 0) & ((score > limit[:, None]) | (score == limit[:, None]) & (name <= limit_id[:, None]))
            who, what = np.nonzero(found)
            if len(who):
                yield at[who], name[who, what], row[who, what], score[who, what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Batch = batch.value
        homes = set(known.home.tolist())
        for part in batches:
            for number, dim, size, ids, rows, *data in zip(*(part.column(c) for c in ("range", "dim", "block", "ids", "rows", "vectors", "largest", "least")), strict=True):
                number, dim, size = number.as_py(), dim.as_py(), size.as_py()
                if at_home and number not in homes:
                    continue
                ids, rows = ids.values.fill_null(_LAST).to_numpy(), rows.values.to_numpy()
                n = -(-len(rows) // size)
                forward, largest, least = (_unpacked(x.as_py(), dim, m) for x, m in zip(data, (len(rows), n, n), strict=True))
                for at, name, row, score in of_range(known, number, dim, size, ids, rows, forward, largest, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, name, row, score.astype(np.int64))], ["at", "id", "row", "score"])

    return run


def _batches(spark: SparkSession, queries: DataFrame) -> Iterator[tuple[pa.Table, DataFrame]]:
    """The queries in parts of about QUERY_BYTES, dealt by the hash of their row."""
    total = queries.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    parts = -(-total // QUERY_BYTES)
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == i).select("row", "id", "vector").toArrow()


def top_k(queries: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): the k best rows of an index for each of some of its numbered rows."""
    spark, path = queries.sparkSession, new_folder(queries.sparkSession, "search-results")
    shape = "query_id long, query_row long, rank int, vec_id long, score long"
    best = Window.partitionBy("at").orderBy(F.col("score").desc(), "id", "row")
    hit = "at long, id long, row long, score long"
    spark.createDataFrame([], shape).write.parquet(path)
    for table in _batches(spark, queries):
        if not table.num_rows:
            continue
        batch = Batch(table)
        sent = spark.sparkContext.broadcast(batch)
        homes = ranges.select("range", "dim", "top", "low").mapInArrow(_homes(sent), "at long, bound double, home long")
        for at, home in homes.groupBy("at").agg(F.max_by("home", F.struct("bound", "home"))).toArrow().to_pandas().itertuples(index=False):
            batch.home[at] = home
        sent = spark.sparkContext.broadcast(batch)
        first = written(ranges.mapInArrow(_scored(sent, k, True), hit), "search-first")
        for at, score, name in first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("at", "score", "id").toArrow().to_pandas().itertuples(index=False):
            batch.score[at], batch.id[at] = score, name
        sent = spark.sparkContext.broadcast(batch)
        hits = first.unionByName(ranges.mapInArrow(_scored(sent, k, False), hit))
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = table.select(["row", "id"]).append_column("place", pa.array(range(table.num_rows), pa.int64()))
        named = F.broadcast(spark.createDataFrame(names.rename_columns(["query_row", "query_id", "place"])))
        found = ranked.join(named, F.col("at") == F.col("place")).withColumn("vec_id", F.when(F.col("id") < F.lit(int(_LAST)), F.col("id")))
        found.select("query_id", "query_row", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def nearest(vectors: DataFrame, step: int = 100, k: int = 10, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k best other rows of every row whose vec_id is divisible by `step`, by the product of quantised vectors."""
    numbered, ranges = index(quantised(vectors, vector, scale))
    return top_k(numbered.where(F.col("id") % step == 0), ranges, k)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of nearest()."""
    return result.select("query_id", "rank", "vec_id", "score")


def oracle_sql() -> str:
    return """
WITH sound AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.rn AS q_rn, q.vec_id AS query_id, d.vec_id, d.rn, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM sound q JOIN sound d ON q.rn <> d.rn WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY q_rn ORDER BY score DESC, vec_id NULLS LAST, rn) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
