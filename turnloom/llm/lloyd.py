"""Lloyd's clustering of whole-number vectors, sharded by their components.

Vectors are packed into chunks of CHUNK rows, and a chunk is cut into blocks of `width` components, one row of the stored
table each. A round is:

1. each block gets the centroids' slice of its components alone and makes exact partial distances of its vectors to every
   slice; the partial distances of a chunk are added up by key, first those that meet in one task, then the others behind a
   shuffle, and the nearest centroid is taken where all blocks of a chunk are together (smaller number on ties);
2. each block gets its chunk's labels and adds up the vectors of each cluster; the sums are pre-aggregated in each task,
   then summed per component and cluster, and each component's shard of the centroids moves to floor(sum / count).

Blocks of a chunk lie behind one another in the stored table, so most chunks are complete in the task that reads them and
only labels leave it; a chunk whose blocks lie apart is put together by the shuffle, with the same result. No task ever needs
more than some slices of centroids at a time, and nothing of the corpus passes the driver.

All sums are of whole numbers, so results depend neither on the order of rows nor on the number of tasks.

Defined results: vectors of another length, null, or with null, NaN or infinite components take no part and have no row;
components beyond +-2^27 after scaling count as +-2^27 (with 64 components, the largest for which any squared distance is a
long); rows that repeat each have a row; an id that is null never starts a centroid; rows of one id start centroids in the
order of their vectors; fewer rows than clusters give as many centroids as there are rows that may start one, and a table
without such rows gives no rows; an empty cluster keeps its centroid; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import written

DIM, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
CHUNK, WIDTH = 256, 16
_LARGEST = 1 << 27
#: Labels, or all slices, of up to so many bytes are sent to where the blocks are; more are joined by a shuffle, with the same rows.
SENT_BYTES = 16 << 20


def quantised(vectors: DataFrame, vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and vector (longs) of the rows whose vectors are sound and of that length."""
    sound = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = lambda x: F.greatest(F.lit(-float(_LARGEST)), F.least(F.lit(float(_LARGEST)), x))
    return vectors.where(sound).select("vec_id", F.transform(vector, lambda x: F.floor(bound(x.cast("double") * scale))).alias("vector"))


def _packed(matrix: np.ndarray) -> bytes:
    kind = "h" if np.abs(matrix).max(initial=0) < 1 << 15 else "i"
    return kind.encode() + matrix.astype(kind).tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=data[:1].decode(), offset=1).reshape(rows, -1).astype(np.int64)


def _blocks(dim: int, width: int, chunk: int, id_type: pa.DataType):
    """Rows as chunks, and these as blocks of components; the first block of a chunk has its ids."""
    shape = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(id_type)), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                matrix = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                starts = range(0, dim, width)
                columns = [
                    pa.array([number] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([len(matrix)] * len(starts), pa.int32()),
                    pa.array([None if j else part.column("vec_id").to_pylist() for j in starts], pa.list_(id_type)), pa.array([_packed(matrix[:, j : j + width]) for j in starts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)
                number += 1

    return run


def blocks(rows: DataFrame, dim: int = DIM, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """The vectors of quantised() as blocks: chunk, block, n, ids (block 0 alone), values."""
    kind = dict(rows.dtypes)["vec_id"]
    from_spark = rows.select("vec_id").limit(0).toArrow().schema.field(0).type
    return rows.mapInArrow(_blocks(dim, width, chunk, from_spark), f"chunk long, block int, n int, ids array<{kind}>, values binary")


def starts(rows: DataFrame, clusters: int, seed: str, width: int) -> DataFrame:
    """(block, place, cluster, value): the vectors whose seeded hash of the id is least, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters)
    numbered = written(first, "lloyd-first").agg(F.sort_array(F.collect_list(F.struct("key", "vector"))).alias("all"))
    one = numbered.select(F.posexplode("all").alias("cluster", "of")).select("cluster", F.posexplode("of.vector").alias("at", "value"))
    return one.select(F.floor(F.col("at") / width).cast("int").alias("block"), (F.col("at") % width).alias("place"), "cluster", "value")


def _slices(centroids: DataFrame) -> DataFrame:
    """One row per block, with the slice as numbers in the order of cluster and place; one block's slice is bounded by its parameters."""
    return centroids.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "place", "value"))), lambda x: x["value"]).alias("slice"))


def partial_distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances over some components, (vectors x centroids)."""
    most = max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * values.shape[1] * float(most) ** 2 < 2.0**53:
        v, c = values.astype(np.float64), centroids.astype(np.float64)
        return ((v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(values), len(centroids)), dtype=np.int64)
    for j in range(values.shape[1]):
        out += (values[:, j, None] - centroids[None, :, j]) ** 2
    return out


_PARTS = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("partial", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("distances", pa.list_(pa.int64()))])
_PARTS_SQL = "chunk long, n int, partial array<long>, labels array<int>, distances array<long>"


def _part(chunk: int, total: np.ndarray, done: bool) -> pa.RecordBatch:
    """A chunk's sum of partial distances, or its labels and distances where all of its blocks are in the sum."""
    labels = total.argmin(axis=1) if done else None
    values = [chunk, len(total), None if done else total.ravel(), labels, total[np.arange(len(total)), labels] if done else None]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PARTS.types, strict=True)], schema=_PARTS)


def _added(of: int):
    """Adds the partial distances of neighbouring blocks of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, count, total = None, 0, None
        for batch in batches:
            for new, n, data, piece in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "values")), batch.column("slice"), strict=True):
                values = _unpacked(data, n)
                distances = partial_distances(values, piece.values.to_numpy().reshape(-1, values.shape[1]))
                if new == chunk:
                    count, total = count + 1, total + distances
                else:
                    if count:
                        yield _part(chunk, total, count == of)
                    chunk, count, total = new, 1, distances
        if count:
            yield _part(chunk, total, count == of)

    return run


def _reduced(table: pa.Table) -> pa.Table:
    """All sums of a chunk as its labels."""
    total = sum(x.values.to_numpy() for x in table.column("partial"))
    return pa.Table.from_batches([_part(table.column("chunk")[0].as_py(), total.reshape(table.column("n")[0].as_py(), -1), True)])


def assigned(stored: DataFrame, centroids: DataFrame, n_blocks: int, light: bool) -> DataFrame:
    """(chunk, labels, distances) of every chunk; light if the slices may be sent to all executors."""
    slices = _slices(centroids)
    parts = stored.select("chunk", "block", "n", "values").join(F.broadcast(slices) if light else slices, "block").select("chunk", "n", "values", "slice")
    parts = written(parts.mapInArrow(_added(n_blocks), _PARTS_SQL), "lloyd-parts")
    apart = parts.where("labels is null").groupBy("chunk").applyInArrow(_reduced, _PARTS_SQL)
    return parts.where("labels is not null").unionByName(apart).select("chunk", "labels", "distances")


def _sums(width: int):
    """What a task's vectors sum to, for each block, place and cluster that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, n, data, labels in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "values")), batch.column("labels"), strict=True):
                labels, values = labels.values.to_numpy(), _unpacked(data, n)
                total, count = sums.get(block, (np.zeros((0, values.shape[1]), np.int64), np.zeros(0, np.int64)))
                more = max(0, int(labels.max()) + 1 - len(count))
                total, count = np.pad(total, ((0, more), (0, 0))), np.pad(count, (0, more))
                np.add.at(total, labels, values)
                np.add.at(count, labels, 1)
                sums[block] = total, count
        for block, (total, count) in sums.items():
            cluster, place = (x.ravel() for x in np.indices(total.shape, dtype=np.int32))
            some = count[cluster] > 0
            columns = [np.full(some.sum(), block, np.int32), place[some], cluster[some], total.ravel()[some], count[cluster][some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "place", "cluster", "total", "n"])

    return run


def moved(stored: DataFrame, centroids: DataFrame, labels: DataFrame, width: int, light: bool) -> DataFrame:
    """The centroids at the floor of their vectors' means; light if the labels may be sent to all executors."""
    own = labels.select("chunk", "labels")
    joined = stored.select("chunk", "block", "n", "values").join(F.broadcast(own) if light else own, "chunk").select("block", "n", "values", "labels")
    sums = joined.mapInArrow(_sums(width), "block int, place int, cluster int, total long, n long")
    sums = sums.groupBy("block", "place", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    value = F.coalesce(F.expr("(total - pmod(total, n)) div n"), F.col("value")).alias("value")
    return written(centroids.join(sums, ["block", "place", "cluster"], "left").select("block", "place", "cluster", value), "lloyd-centroids")


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, width: int = WIDTH, chunk: int = CHUNK, seed: str = "2") -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every vector of quantised(), and the final centroids (block, place, cluster, value)."""
    stored = written(blocks(rows, dim, width, chunk), "lloyd-blocks")
    centroids = written(starts(rows, clusters, seed, width), "lloyd-centroids")
    n_blocks = -(-dim // width)
    few = 8 * clusters * dim <= SENT_BYTES
    light = 4 * stored.where("block = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= SENT_BYTES
    for _ in range(rounds):
        centroids = moved(stored, centroids, assigned(stored, centroids, n_blocks, few), width, light)
    labels = assigned(stored, centroids, n_blocks, few).join(stored.where("block = 0").select("chunk", "ids"), "chunk")
    one = labels.select(F.explode(F.arrays_zip("ids", "labels", "distances")).alias("x"))
    return written(one.select(F.col("x.ids").alias("vec_id"), F.col("x.labels").alias("cluster"), F.col("x.distances").alias("distance")), "lloyd-labels"), centroids


def digest(result: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The contract's columns of a result of clustered(): distances summed up over clusters and all, and centroids' digests."""
    rows, centroids = result
    whole = lambda x: F.least(x, F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("part"))
    components = F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"].cast("string"))
    digests = centroids.groupBy("cluster").agg(F.sha2(F.concat_ws(",", components), 256).alias("centroid_sha256"))
    # One row for each cluster: as many as the parameter says at most.
    total = F.sum("part").over(Window.partitionBy(F.lit(0)))
    named = sums.withColumn("total", total).join(digests, "cluster").select("cluster", whole(F.col("part")).alias("cluster_inertia"), whole(F.col("total")).alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """All rounds written out, one after the other; products of doubles are exact here."""
    near = """
p{i} AS MATERIALIZED (
  SELECT rn, vec_id, v, cluster, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM kept, c{i}
), a{i} AS MATERIALIZED (
  SELECT rn, vec_id, v, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY d, cluster) AS place FROM p{i}) WHERE place = 1
)"""
    move = """
s{i} AS (
  SELECT cluster, j, sum(v[j]::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY cluster, j
), m{i} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM s{i} GROUP BY cluster
), c{k} AS MATERIALIZED (
  SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster)
)"""
    parts = [(near + "," + move).format(i=i, k=i + 1) for i in range(rounds)] + [near.format(i=rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1)::INTEGER AS cluster, v AS c
  FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id::VARCHAR), v LIMIT {clusters}
), {",".join(parts)}
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
