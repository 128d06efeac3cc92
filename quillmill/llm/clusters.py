"""Ball k-means: exact Lloyd rounds that compare a vector only with centroids that can take it.

Vectors are integers (``floor(scale * x)``) and lie in blocks of up to ``BLOCK``,
in a table bucketed by block.  What changes from round to round is a second
table with the same buckets: a block's clusters, distances and sums.  A round
joins the two without a shuffle, so vectors are shuffled and written once.

Within a block a cluster is a ball around its new centroid whose radius is the
distance of its furthest member.  For centroids ``i`` and ``j`` at distance ``D``, a
member of ``i`` can prefer ``j`` only if it lies at least ``D / 2`` from ``i``.  So ``j``
is a neighbour of the ball only if its radius reaches ``D / 2``; members nearer
than half the way to the nearest neighbour are the stable core and are
compared with nothing; and the sorted halves of the other neighbours cut the
rest into annuli, each compared with the neighbours inside it.  All of it is
integer arithmetic, so results are those of a comparison with all centroids.

Sums by cluster are added up from blocks to groups of blocks and then to the
driver, which holds the centroids: ``k`` rows.

Defined results: a vector takes part if it has ``dims`` components, none null or
non-finite; components beyond ``largest(dims)`` after scaling (2^27 for 64) count as that bound;
vectors without an id take part, but start a centroid only after all others;
equal hashes start in the order of the vectors; fewer vectors than ``k`` start
fewer centroids; each of repeated rows counts; a sum of distances beyond a
long is null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

#: Vectors of a block, and of a bucket of blocks where there are many.
BLOCK, BUCKET = 4096, 1 << 18
#: Most buckets of a table.
BUCKETS = 50_000
#: Groups of blocks whose sums are added before the driver adds the rest.
GROUPS = 64
_STATE = "block long, grp int, clusters binary, distances binary, sums binary"


def largest(dims: int) -> int:
    """Components up to this give squared distances of a long."""
    return min(math.isqrt((1 << 62) // dims) // 2, (1 << 31) - 1)


def scaled(flat: np.ndarray, scale: float, dims: int) -> np.ndarray:
    bound = largest(dims)
    return np.floor(flat.astype(np.float64) * scale).clip(-bound, bound).astype(np.int64).reshape(-1, dims)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = vectors - centroid
    return np.einsum("ij,ij->i", d, d)


def half_ways(centroids: np.ndarray) -> np.ndarray:
    """Least squared distance from ``i`` at which ``j`` is as near, for all pairs: a quarter of theirs, rounded up."""
    return np.stack([(squared(centroids, c) + 3) // 4 for c in centroids])


def reassign(vectors: np.ndarray, clusters: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector, and how many distances were worked out.

    ``clusters`` are those of the round before; any will do.
    """
    halves = half_ways(centroids)
    best, nearest, compared = clusters.copy(), np.zeros(len(vectors), np.int64), 0
    for i in np.unique(clusters).tolist():
        members = np.flatnonzero(clusters == i)
        own = squared(vectors[members], centroids[i])
        compared += len(members)
        radius = own.max()
        others = [j for j in np.argsort(halves[i], kind="stable").tolist() if j != i and halves[i, j] <= radius]
        annulus = np.searchsorted(halves[i, others], own, side="right")  # how many neighbours are inside
        least, chosen = own.copy(), np.full(len(members), i)
        for rank, j in enumerate(others):
            rest = np.flatnonzero(annulus > rank)
            d = squared(vectors[members[rest]], centroids[j])
            compared += len(rest)
            closer = (d < least[rest]) | ((d == least[rest]) & (j < chosen[rest]))
            least[rest[closer]], chosen[rest[closer]] = d[closer], j
        best[members], nearest[members] = chosen, least
    return best, nearest, compared


def block_sums(vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """By cluster: count, sum of distances in two halves of 31 bits, sums of components."""
    out = np.zeros((k, 3 + vectors.shape[1]), np.int64)
    np.add.at(out[:, 0], clusters, 1)
    np.add.at(out[:, 1], clusters, distances >> 31)
    np.add.at(out[:, 2], clusters, distances & 0x7FFFFFFF)
    for c in np.unique(clusters).tolist():
        out[c, 3:] = vectors[clusters == c].sum(axis=0)
    return out


def _vector(vector_col: str) -> Column:
    return F.col(vector_col).cast("array<double>")


def usable(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part."""
    bad = F.exists(_vector(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(vector_col) == dims) & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), _vector(vector_col).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str, scale: float, dims: int) -> np.ndarray:
    """The vectors whose hash of seed and id is least; ``k`` rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in found], np.float64).ravel(), scale, dims)


def to_blocks(rows: DataFrame, scale: float, dims: int) -> DataFrame:
    """``(block, ids, data, n)``: ids as they are, vectors as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for x in range(0, batch.num_rows, BLOCK):
                part = batch.slice(x, BLOCK)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                data = scaled(flat, scale, dims).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([part.num_rows])], ["block", "ids", "data", "n"])
                at += 1

    return rows.mapInArrow(run, "block long, ids array<long>, data binary, n long")


class Bucketed:
    """Tables with the same buckets of blocks, in scratch space; dropped from the catalog and from disk after use."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.prefix = scratch, buckets, f"qm_balls_{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.prefix}_{name}"
        df.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.scratch.path}/{name}").saveAsTable(table)
        return self.scratch.spark.table(table)

    def drop(self, name: str) -> None:
        self.forget(name)
        self.scratch.drop(name)

    def forget(self, name: str) -> None:
        """Leaves the files to a result that still reads them, and nothing in the catalog."""
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def next_state(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray) -> DataFrame:
    """Clusters, distances and sums of each block; without a state all vectors start in the first ball."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("clusters").to_pylist() if "clusters" in batch.schema.names else [None] * batch.num_rows
            for block, data, old in zip(batch.column("block").to_pylist(), batch.column("data"), before):
                vectors = np.frombuffer(data.as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
                clusters = np.zeros(len(vectors), np.int64) if old is None else np.frombuffer(old, np.int16).astype(np.int64)
                clusters, distances, _ = reassign(vectors, clusters, centroids)
                row = [[block], [block % GROUPS], [clusters.astype(np.int16).tobytes()], [distances.tobytes()], [block_sums(vectors, clusters, distances, k).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "grp", "clusters", "distances", "sums"])

    rows = blocks.select("block", "data")
    if state is not None:
        rows = rows.join(state.select("block", "clusters").hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, _STATE)


def totals(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """Sums of all blocks as integers without bound: a group's sums as halves, so that nothing overflows on the way."""
    width = k * (3 + dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, any_rows = np.zeros(width, np.int64), np.zeros(width, np.int64), False
        for batch in batches:
            for x in batch.column("sums"):
                part = np.frombuffer(x.as_buffer(), np.int64)
                high += part >> 31
                low += part & 0x7FFFFFFF
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], ["high", "low"])

    parts = state.select("grp", "sums").repartition(min(GROUPS, shuffle_width(state.sparkSession)), "grp").mapInArrow(run, "high array<long>, low array<long>").collect()
    sums = [0] * width
    for high, low in parts:
        sums = [s + (h << 31) + x for s, h, x in zip(sums, high, low)]
    return [sums[c * (3 + dims) : (c + 1) * (3 + dims)] for c in range(k)]


def moved(centroids: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """Componentwise floor of the means; a centroid without vectors stays."""
    return np.array([[x // row[0] for x in row[3:]] if row[0] else own.tolist() for own, row in zip(centroids, sums)], np.int64)


def ball_k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024, dims: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` (``array<long>``): one row a vector that takes part."""
    if not 0 < k < 1 << 15:
        raise ValueError("k must be from 1 to 32767")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "balls")
    rows = usable(vectors, dims, id_col, vector_col)
    centroids = first_centroids(rows, k, seed, scale, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    made = scratch.save(to_blocks(rows, scale, dims), "made")
    n = made.agg(F.sum("n")).first()[0]
    buckets = int(min(BUCKETS, max(shuffle_width(spark), n // BUCKET)))
    tables = Bucketed(scratch, buckets)
    blocks = tables.save(made.repartition(buckets, "block"), "blocks")
    scratch.drop("made")
    state = None
    for r in range(rounds + 1):
        new = tables.save(next_state(blocks, state, centroids), f"state_{r}")
        if r:
            tables.drop(f"state_{r - 1}")
        state, sums = new, totals(new, len(centroids), dims)
        if r < rounds:
            centroids = moved(centroids, sums)
    spread = [(row[1] << 31) + row[2] for row in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, clusters, distances in zip(batch.column("ids"), batch.column("clusters"), batch.column("distances")):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(clusters.as_buffer(), np.int16).astype(np.int32)), pa.array(np.frombuffer(distances.as_buffer(), np.int64))], ["vec_id", "cluster", "distance"])

    found = blocks.select("block", "ids").join(state.select("block", "clusters", "distances").hint("shuffle_hash"), "block").mapInArrow(run, "vec_id long, cluster int, distance long")
    for name in ("blocks", f"state_{rounds}"):
        tables.forget(name)
    long = lambda x: x if x < 1 << 63 else None
    balls = [(c, long(spread[c]), long(sum(spread)), centroids[c].tolist()) for c in range(len(centroids))]
    balls = spark.createDataFrame(balls, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(balls), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str = "centroid") -> Column:
    """Hex SHA-256 of a centroid's components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

