import hashlib
import random

import pytest

from calspark.llm.exact_dedup import SPACES, Polynomial, exact_duplicates

SCHEMA = "doc_id long, text string, h0 string, norm int"


def brute(rows):
    norm = {}
    for i, (doc, text, *_) in enumerate(rows):
        norm.setdefault((text or "").encode().translate(None, SPACES), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for n, own in norm.items():
        keep = min(own)[-1]
        out += [(doc, keep, len(own), doc == keep, hashlib.sha256(n).hexdigest()) for *_, doc in own]
    return sorted(map(str, out))


def made(n, seed):
    rnd = random.Random(seed)
    texts = ["", None, " \t\n", "a b", "ab", " ab", "é x", "x" * 9000, "x " * 9000, "y" * 8999 + "z", "y" * 9000]
    return [(i, rnd.choice(texts) if rnd.random() < 0.7 else "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 6))), "clash", 1) for i in range(n)]


@pytest.mark.parametrize(("primes", "group_rows"), [((2147483647, 2147483629), 4096), ((3, 2), 2)])
def test_equals_brute_force(spark, primes, group_rows):
    """Also with hashes that collide, chunks of a few bytes and groups dealt to several tasks."""
    rows = [*made(150, 1), (None, "ab", "c", 2), (7, "a b", "c", 2)]
    rows = [(100 + i if d == 7 else d, *r) for i, (d, *r) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_duplicates(df, primes=primes, bases=(5, 7), chunk_bytes=1024, group_rows=group_rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hashes_compose():
    p, data = Polynomial(), bytes(random.Random(2).randbytes(5000))
    for cut in (0, 1, 999, 5000):
        assert p.joined(p.chunk(data[:cut]), p.chunk(data[cut:]), 5000 - cut) == p.chunk(data)
