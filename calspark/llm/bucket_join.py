"""Joining rows that share a bucket, for similarity joins by locality-sensitive hashing.

A row has keys in several tables; rows with a key in common are compared. Buckets of the same members are compared
once. A bucket is dealt into blocks of bounded size, and each pair of blocks is a tile: the rows of a tile come to
one task, which compares blocks as matrices and returns a count for each row and a spanning forest of the links,
never a row for each pair. A pair belongs to the least bucket that it shares, so that it counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, grouped, joined, width

#: Rows of a block, and what their sizes may add up to.
BLOCK_ROWS, BLOCK_SIZE = 1024, 2_000_000
TILE = ["table", "key", "lo", "hi"]


def tiles(rows: DataFrame, per_table: int, block_rows: int = BLOCK_ROWS, block_size: int = BLOCK_SIZE) -> DataFrame:
    """table, key, lo, hi and id of the members of every tile; ``rows`` has id, size and keys (array of long, per_table of each table)."""
    every = rows.select("id", "size", F.posexplode("keys").alias("place", "key")).select("id", "size", F.floor(F.col("place") / per_table).cast("int").alias("table"), "key")
    every = every.dropDuplicates(["id", "table", "key"]) if per_table > 1 else every
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"), F.sum("size").alias("total")]
    buckets = every.groupBy("table", "key").agg(*members).filter("n > 1")
    kept = cut(buckets.groupBy("n", "x", "y").agg(F.min(F.struct("table", "key")).alias("first"), F.max("total").alias("total")))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_size)).cast("int")
    kept = kept.select("first.table", "first.key", "n", blocks.alias("blocks"))
    found = joined(every, kept, ["table", "key"], "n", kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    found = found.select("table", "key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return found.select("table", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id")


def dealt(df: DataFrame) -> DataFrame:
    """The rows of each tile one after the other in one task."""
    return df.repartition(width(df), *TILE).sortWithinPartitions(*TILE)


def matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    """A column of lists of the same size, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def owned(table: int, key: int, a: np.ndarray, b: np.ndarray, per_table: int) -> np.ndarray:
    """Whether the pairs of rows of a and b have this bucket as their least."""
    out = np.ones((len(a), len(b)), bool)
    for t in range(table + 1):
        for i in range(t * per_table, (t + 1) * per_table):
            for j in range(t * per_table, (t + 1) * per_table):
                same = a[:, i, None] == b[None, :, j]
                out &= ~(same & (a[:, i, None] < key)) if t == table else ~same
    return out


def halves(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the two blocks of a tile, and whether they are one block."""
    block, lo = tile.column("block").to_numpy(), tile.column("lo")[0].as_py()
    if lo == tile.column("hi")[0].as_py():
        every = np.arange(tile.num_rows)
        return every, every, True
    return np.flatnonzero(block == lo), np.flatnonzero(block != lo), False


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


Verify = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Callable[[], np.ndarray]], np.ndarray]


def compared(df: DataFrame, verify: Verify, per_table: int) -> DataFrame:
    """id, links and other: for each tile the weight linked with each row, and a forest of links.

    ``df`` has what ``tiles`` returns, keys, weight and what ``verify`` reads; verify(tile, rows, rows, owned) returns
    the matrix of the pairs that are links and owned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, TILE):
            a, b, one = halves(tile)
            if not len(a) or not len(b):
                continue
            keys, table, key = matrix(tile.column("keys")), tile.column("table")[0].as_py(), tile.column("key")[0].as_py()
            found = verify(tile, a, b, lambda: owned(table, key, keys[a], keys[b], per_table))  # noqa: B023
            if one:
                found = np.triu(found, 1)
            i, j = np.nonzero(found)
            if not len(i):
                continue
            weight, ids = tile.column("weight").to_numpy().astype(np.float64), tile.column("id").to_numpy()
            links = np.bincount(a[i], weight[b[j]], tile.num_rows) + np.bincount(b[j], weight[a[i]], tile.num_rows)
            on = np.flatnonzero(links)
            root = forest(tile.num_rows, a[i], b[j])[on]
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on].astype(np.int64)), pa.array(ids[root])], ["id", "links", "other"])

    return dealt(df).mapInArrow(run, "id long, links long, other long")
