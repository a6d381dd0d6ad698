"""Centroid clustering over subvector dictionaries.

Components become whole numbers, so all distances are exact. Vectors are gathered in chunks, and each chunk is stored
as dictionaries: its dimensions are divided into blocks, the distinct subvectors of a block are listed once, and a
vector is one code for each block; nothing is lost. In a round the distances from a block's distinct subvectors to all
centroids are computed once, and the distance of a vector is the sum of those that its codes name. The sums of a
cluster's members come from how often it has each code. How wide the blocks are follows from the chunk: wide where
subvectors repeat (copies are one code), narrow where only single components do.

Chunks are rows of a checkpointed table, so a lost one is read again; a round shuffles one row for each task, cluster
and dimension, and only the centroids (CLUSTERS times DIMENSIONS numbers, whatever the input) go through the driver.

Defined cases: vectors that are null, of another size or hold null or non-finite components are left out; scaled components
beyond 2^26 count as 2^26; repeated rows are vectors of their own; among rows with the same vec_id the one
with the smaller components starts first, rows without a vec_id start last; fewer vectors than clusters give as many
clusters as vectors; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SALT = 40, 64, 5, 256, "2:"
#: Scaled components are held within these bounds, so that sums of squares fit into 64 bits.
LARGEST = 1 << 26
#: Vectors of a chunk, at most: codes have 16 bits.
CHUNK = 1 << 14
CHUNK_SCHEMA = "vec_ids array<long>, width int, codes binary, sizes array<int>, subvectors binary"


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix, and for each row the number of its own."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, code = np.unique(whole, return_index=True, return_inverse=True)
    return rows[first], code


def best_width(vectors: np.ndarray) -> int:
    """The width of blocks that costs least: a sum for each code of a vector, a distance for each distinct subvector."""
    n, dims = vectors.shape
    widths = [w for w in (1 << i for i in range(dims.bit_length())) if dims % w == 0]
    cost = {w: n * dims // w + dims * len(distinct_rows(vectors[:, :w])[0]) for w in widths}
    return min(widths, key=cost.get)


class Chunk:
    """Vectors as codes of the distinct subvectors of each block."""

    def __init__(self, width: int, codes: np.ndarray, subvectors: list[np.ndarray]):
        self.width, self.codes, self.subvectors = width, codes, subvectors

    @classmethod
    def of(cls, vectors: np.ndarray, width: int | None = None) -> Chunk:
        width = width or best_width(vectors)
        blocks = [distinct_rows(vectors[:, at: at + width]) for at in range(0, vectors.shape[1], width)]
        return cls(width, np.stack([code for _, code in blocks]).astype(np.uint16), [own for own, _ in blocks])

    def vectors(self) -> np.ndarray:
        return np.hstack([own[code] for own, code in zip(self.subvectors, self.codes, strict=True)])

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (the smaller number of equal ones) and its squared distance."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for b, (own, code) in enumerate(zip(self.subvectors, self.codes, strict=True)):
            part = own[:, None, :].astype(np.int64) - centroids[None, :, b * self.width: (b + 1) * self.width]
            total += (part * part).sum(2)[code]
        best = total.argmin(1)
        return best, total[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, clusters: int) -> np.ndarray:
        """The componentwise sums of the members of each cluster."""
        out = []
        for own, code in zip(self.subvectors, self.codes, strict=True):
            often = np.bincount(best * len(own) + code, minlength=clusters * len(own)).reshape(clusters, len(own))
            out.append(often @ own.astype(np.int64))
        return np.hstack(out)

    def row(self, ids: pa.Array) -> pa.RecordBatch:
        sizes = [len(own) for own in self.subvectors]
        columns = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([self.width], pa.int32()), pa.array([self.codes.tobytes()], pa.binary()),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(own.astype("<i4").tobytes() for own in self.subvectors)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["vec_ids", "width", "codes", "sizes", "subvectors"])


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            width, sizes = batch.column("width")[i].as_py(), batch.column("sizes")[i].as_py()
            own = np.frombuffer(batch.column("subvectors")[i].as_buffer(), "<i4").reshape(-1, width)
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(len(sizes), -1)
            yield batch.column("vec_ids")[i].values, Chunk(width, codes, np.split(own, np.cumsum(sizes)[:-1]))


def whole_vectors(df: DataFrame) -> DataFrame:
    """vec_id and the scaled vector (array of int) of the rows that take part."""
    x = F.col("x")
    infinite = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(F.size(x) == DIMENSIONS).filter(~F.exists(x, infinite))
    bound = F.lit(LARGEST).cast("long")
    return rows.select("vec_id", F.transform(x, lambda v: F.least(F.greatest(F.floor(v * SCALE), -bound), bound).cast("int")).alias("v"))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            vectors = part.column("v").flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.int32)
            yield Chunk.of(vectors).row(part.column("vec_id"))


def _totals(centroids: np.ndarray):
    """The number of members of each cluster and the sum of each of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, chunk in _chunks_of(batches):
            best, _ = chunk.nearest(centroids)
            sums += chunk.sums(best, k)
            n += np.bincount(best, minlength=k)
        on = np.repeat(n > 0, dims)
        columns = [np.repeat(np.arange(k, dtype=np.int32), dims), np.tile(np.arange(dims, dtype=np.int32), k), sums.ravel(), np.repeat(n, dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in columns], ["cluster", "dim", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks_of(batches):
            best, distance = chunk.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    vectors = whole_vectors(df)
    order = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k vectors, whatever the input
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), DIMENSIONS)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    chunks = cut(vectors.mapInArrow(_encoded, CHUNK_SCHEMA))
    for _ in range(rounds):
        found = chunks.mapInArrow(_totals(centroids), "cluster int, dim int, total long, n long")
        centroids = centroids.copy()
        for r in found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toLocalIterator():  # k * DIMENSIONS rows
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
    assigned = cut(chunks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = [(c, s, sum(inertia.values()), texts[c]) for c, s in inertia.items()]
    of = df.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(*(c.split()[0] for c in schema.split(", ")))
