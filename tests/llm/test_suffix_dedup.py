import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from calspark.llm.suffix_dedup import BODIES, Pieces, _shards, common_prefixes, suffix_array, without_repeats


def brute(rows, match):
    places = defaultdict(int)
    texts = [(doc, (text or "").encode()) for doc, text, *_ in rows]
    for _, t in texts:
        for i in range(len(t) - match + 1):
            places[t[i: i + match]] += 1
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - match + 1):
            if places[t[i: i + match]] > 1:
                gone[i: i + match] = b"\1" * match
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def made(seed, n=60):
    rnd = random.Random(seed)
    word = lambda k, letters: "".join(rnd.choice(letters) for _ in range(k))
    passages = [word(rnd.randint(10, 80), "abcdé ") for _ in range(6)]
    rows = [(0, None, "x"), (1, "", "x"), (2, "ab" * 60, "x"), (3, "a" * 45, "x"), (4, "a" * 24, "x"), (None, passages[0] * 2, "x")]
    for i in range(n):
        text = "".join(rnd.choice([*passages, word(rnd.randint(1, 40), "abcdefgh")]) for _ in range(rnd.randint(0, 7)))
        rows.append((10 + i, text, "x"))
    return rows + [(500, rows[20][1], "x"), (501, rows[20][1], "x"), rows[21], rows[21]]


@pytest.mark.parametrize(("seed", "match", "shard_bytes"), [(1, 24, 2_000_000), (2, 24, 120), (3, 37, 300)])
def test_equals_brute_force(spark, seed, match, shard_bytes):
    """Also with anchors dealt to many shards, which are merged by their digests."""
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = without_repeats(df, match, 8, shard_bytes)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, match)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffixes_and_prefixes():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))).encode() for _ in range(30)] + [b"a" * 50, b"a" * 50]
    sizes = np.array(list(map(len, texts)))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_array(data, begins, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    suffix = [texts[owner[i]][i - begins[owner[i]]:] for i in order]
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert all(a[: common(a, b) + 1] <= b[: common(a, b) + 1] or len(a) == common(a, b) or len(b) == common(a, b) for a, b in zip(suffix, suffix[1:]))
    found = common_prefixes(data, begins, sizes, order, 20)[order]
    assert found.tolist() == [0, *(min(20, common(a, b)) for a, b in zip(suffix, suffix[1:]))]


def test_equal_strings_have_equal_anchors():
    rnd = random.Random(6)
    texts = [bytes(rnd.choice(b"ab") for _ in range(200)) for _ in range(20)]
    p, seen = Pieces(texts, 40, 16), {}
    for t, first, count, anchor in zip(p.text, p.first, p.count, p.anchor):
        for i in range(first, first + count):
            assert seen.setdefault(texts[t][i: i + 40], anchor) == anchor
    assert sum(p.count) == 20 * 161


def test_memory_of_a_shard_is_bounded():
    """A shard of more bytes than meant, of many anchors: its arrays are made of some anchors at a time, with the same runs found."""
    rnd = np.random.default_rng(1)
    base = [rnd.integers(97, 123, 9_000, dtype=np.uint8).tobytes() for _ in range(40)]
    at = rnd.integers(0, 8_000, (40, 50)).tolist()
    rows = [(0, 0, 1, a, 50 * a + i, 0, 1, 400, base[a][x: x + 799]) for a, own in enumerate(at) for i, x in enumerate(own)]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in BODIES.split(", ")]
    shard = pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])

    def run(limit):
        tracemalloc.start()
        found = [r for batch in _shards(400, limit)(iter([shard])) for r in batch.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sorted((r["d0"], r["first"], r["count"]) for r in found), peak

    (whole, most), (parts, least) = run(10_000_000), run(100_000)
    assert whole == parts and len(whole) > 1_000
    assert least < 30_000_000 < 100_000_000 < most
