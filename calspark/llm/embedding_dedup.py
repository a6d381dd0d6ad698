"""Near-duplicate vectors by cross-polytope hashing.

Vectors of length one are rotated by random signs and fast Hadamard transforms, three times; the axis nearest to
the result is a hash, and several of them make a bucket. Besides its nearest axes, a vector is put under those that
are next best (multiprobe), in each of several tables. Rows that share a bucket are compared by their cosine in double
precision. Equal vectors of a label are one row with a weight, so copies are never paired.

How many axes make a bucket follows from the number of vectors of a label: unrelated vectors should hardly ever share
one, however large the table, so the pairs compared grow with the true ones. How many tables there are follows from the
axes: random pairs at the threshold itself are hashed to see how often a table brings them together, and tables are
added until all of them together miss one in MISSED.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing; only vectors of the same size are compared; vec_id is to be unique, and repeated rows of an id
count as copies; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_join import compared, matrix, tiles
from .components import components
from .shared import cut, joined

THRESHOLD = 0.93
#: Further buckets that each vector is put into in each table.
PROBES = 3
ROUNDS = 3
#: Buckets for each vector of a label, at least; a pair at the threshold that all tables together miss, of so many.
ROOM, MISSED = 64, 1000
#: Pairs that are hashed to see how often they meet.
TRIALS = 1000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose size is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows after random signs and transforms; all vectors of a size are rotated alike."""
    size = width_of(x.shape[1])
    rng = np.random.default_rng([seed, size])
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for _ in range(ROUNDS):
        out = hadamard(out * rng.choice([-1.0, 1.0], size))
    return out


def width_of(size: int) -> int:
    """Axes after the rotation: enough for the probes, also of small vectors."""
    return 1 << max(3, int(np.ceil(np.log2(size))))


def cheapest(losses: list[np.ndarray], probes: int) -> np.ndarray:
    """For each row the combinations (a rank for each hash) that lose least, the best first."""
    combinations, total = np.zeros((len(losses[0]), 1, 0), np.int64), np.zeros((len(losses[0]), 1))
    for own in losses:  # the best of more hashes are among the best of fewer
        joint = (total[:, :, None] + own[:, None, :]).reshape(len(own), -1)
        order = np.argsort(joint, axis=1, kind="stable")[:, : probes + 1]
        before, rank = order // own.shape[1], order % own.shape[1]
        combinations = np.concatenate([np.take_along_axis(combinations, before[:, :, None], 1), rank[:, :, None]], 2)
        total = np.take_along_axis(joint, order, 1)
    return combinations


def buckets(x: np.ndarray, label: np.ndarray, axes: int, tables: int, probes: int = PROBES, first: int = 0) -> np.ndarray:
    """The keys of vectors of length one: 1 + probes of each table, from table ``first`` on."""
    label = label.astype(np.uint64)
    keys = []
    for t in range(first, first + tables):
        names, losses = [], []
        for k in range(axes):
            r = rotated(x, t * 64 + k)
            size = np.abs(r)
            best = np.argpartition(-size, probes, axis=1)[:, : probes + 1]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
            size = np.take_along_axis(size, best, 1)
            names.append(best * 2 + (np.take_along_axis(r, best, 1) < 0))
            losses.append(size[:, :1] ** 2 - size**2)
        chosen = cheapest(losses, probes)
        mixed = label[:, None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(t * 1000003 + x.shape[1] * 7919)
        for k in range(axes):
            mixed = (mixed ^ np.take_along_axis(names[k], chosen[:, :, k], 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        keys.append(mixed)
    return np.concatenate(keys, 1).view(np.int64)


def axes_for(size: int, vectors: int) -> int:
    """Hashes of a bucket: as many as give ROOM buckets for each vector of a label."""
    return max(1, int(np.ceil(np.log(max(vectors, 1) * ROOM) / np.log(2 * width_of(size)))))


def tables_for(size: int, axes: int, threshold: float, probes: int = PROBES) -> int:
    """Tables until all of them together miss one pair in MISSED, by random pairs at the threshold."""
    rng = np.random.default_rng([7, size])
    x, y = rng.normal(size=(2, TRIALS, max(size, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(1 - threshold**2, 0)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    one = np.zeros(TRIALS)
    a, b = (buckets(v, one, axes, 2, probes).reshape(TRIALS, 2, -1) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean()
    return max(2, int(np.ceil(np.log(1 / MISSED) / np.log(1 - min(max(met, 1e-3), 0.99)))))


def _hashed(axes: dict[int, int], tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = matrix(own.column("vector"), np.float64)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = buckets(x, own.column("tag").to_numpy().astype(np.int64), axes[width_of(int(size))], tables, probes)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.FixedSizeListArray.from_arrays(keys.ravel(), keys.shape[1]).cast(pa.list_(pa.int64()))], [*own.schema.names, "keys"])

    return run


def _cosine(threshold: float):
    def verify(tile, a, b, owned):
        sizes, tags = tile.column("size").to_numpy(), tile.column("tag").to_numpy()
        if len(np.unique(sizes)) > 1:  # a bucket has vectors of one size, unless two keys are equal by chance
            out = np.zeros((len(a), len(b)), bool)
            for size in np.unique(sizes):
                i, j = np.flatnonzero(sizes[a] == size), np.flatnonzero(sizes[b] == size)
                x = [matrix(tile.column("vector").take(pa.array(r)), np.float64) for r in (a[i], b[j])]
                out[np.ix_(i, j)] = _near(*x, threshold)
        else:
            x = matrix(tile.column("vector"), np.float64)
            out = _near(x[a], x[b], threshold)
        out &= tags[a][:, None] == tags[b][None, :]
        return out & owned() if out.any() else out

    return verify


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
    return x @ y.T / norms >= threshold


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, **blocks: int) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    base = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("tag"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("valid", F.coalesce(F.col("vec_id").isNotNull() & F.col("tag").isNotNull() & finite, F.lit(False)))
    groups = base.filter("valid").groupBy("tag", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    groups = cut(groups.select("id", "tag", "weight", "vector", F.size("vector").cast("long").alias("size")))
    # a row for each width of vectors (powers of two)
    wide = F.ceil(F.log2(F.greatest(F.col("size"), F.lit(8)))).cast("int")
    largest = groups.groupBy("tag", wide.alias("wide")).agg(F.count(F.lit(1)).alias("n")).groupBy("wide").agg(F.max("n").alias("n")).collect()
    axes = {1 << r["wide"]: axes_for(1 << r["wide"], r["n"]) for r in largest}
    tables = max((tables_for(size, k, threshold, probes) for size, k in axes.items()), default=1)
    rows = cut(groups.mapInArrow(_hashed(axes, tables, probes), "id long, tag long, weight long, vector array<double>, size long, keys array<long>"))
    found = tiles(rows.select("id", F.lit(1).cast("long").alias("size"), "keys"), 1 + probes, **blocks).join(rows, "id")
    found = cut(compared(found, _cosine(threshold), 1 + probes))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    nodes = rows.select("id", "tag", "weight", "vector").join(links, "id", "left").join(roots, "id", "left")
    nodes = cut(nodes.select("tag", "vector", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    total = nodes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    own = joined(base.filter("valid"), nodes, ["tag", "vector"], "weight", total).select("vec_id", "n_links", "component_id")
    none = base.filter("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
