import hashlib

import numpy as np
import pytest

from calspark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, codes string, width int"


def brute(rows, k, rounds):
    kept = [(i, [min(max(int(np.floor(256 * x)), -(2**26)), 2**26) if abs(x) < 1e15 else (2**26 if x > 0 else -(2**26)) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(v) for _, v in first]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, c in near if c == j) for j in range(len(centres))]
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(str((i, c, d, inertia[c], sum(inertia), shown[c])) for (i, _), (d, c) in zip(kept, near))


def made(seed, n):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 64)) / 8
    rows = [(i, (centre[rng.integers(5)] + rng.normal(size=64) / 40).tolist(), "x", 1) for i in range(n)]
    odd = [(900, None), (901, []), (902, [0.1] * 63), (903, [None, *[0.1] * 63]), (904, [float("inf")] * 64), (905, [float("nan")] * 64), (906, [1e300] * 64), (907, [-1e300] * 64), (None, [0.25] * 64), (3, [0.5] * 64)]
    return rows + [rows[0]] * 30 + [(*r, "x", 1) for r in odd]


@pytest.mark.parametrize(("n", "k"), [(120, 7), (3, 40)])
def test_equals_brute_force(spark, n, k):
    """With copies, odd rows, repeated ids and fewer vectors than clusters."""
    rows = made(n, n)
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, k, centroids.ROUNDS)


def test_empty_table(spark):
    assert centroids.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 16, 64, None])
def test_dictionaries_lose_nothing(width):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-5, 5, (200, 64)).astype(np.int32)
    vectors[50:] = vectors[rng.integers(0, 50, 150)]
    chunk, centres = centroids.Chunk.of(vectors, width), rng.integers(-5, 5, (6, 64))
    assert (chunk.vectors() == vectors).all()
    best, distance = chunk.nearest(centres)
    exact = ((vectors[:, None] - centres) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert (chunk.sums(best, 6) == [vectors[best == j].sum(0) for j in range(6)]).all()
    assert centroids.best_width(np.repeat(vectors[:2], 400, axis=0)) == 64  # copies: whole vectors are the words
