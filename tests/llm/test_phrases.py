import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from calspark.llm import phrases

SCHEMA = "doc_id long, text string, runs string, first int"


def brute(rows, window):
    words = [(doc, (text or "").encode().split()) for doc, text, *_ in rows]
    count = Counter(tuple(w[i: i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for doc, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i: i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(map(str, out))


def made(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "é", "漢\x85字", "x" * 300, "\xa0", *(f"w{i}" for i in range(30))]
    some = lambda n: rnd.choices(words, k=n)
    passages = [some(n) for n in (5, 9, 11, 14, 30)]
    rows = [(0, None), (1, " \n\x0b\t"), (2, "a " * 60), (3, "a b " * 30), (4, "a"), (None, " ".join(passages[3] * 2)), (5, "z " * 20000)]
    for i in range(70):
        parts = [rnd.choice([*passages, some(rnd.randint(1, 9))]) for _ in range(rnd.randint(0, 6))]
        rows.append((10 + i, rnd.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    return [(*r, "clash", 1) for r in [*rows, (500, rows[20][1]), (501, rows[20][1]), rows[21], rows[21]]]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"shard_words": 40}), (3, {"shard_words": 100, "hot_stretches": 2})])
def test_equals_brute_force(spark, seed, sizes):
    """Also with many shards, and with anchors taken apart into windows."""
    rows = made(seed)
    got = phrases.without_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), window=8, gram=4, **sizes)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 8)


def test_without_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bits_for", lambda keys: None)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 16)
    rows = made(4)
    got = phrases.without_phrases(spark.createDataFrame(rows, SCHEMA), window=8, gram=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 8)


def test_empty_table(spark):
    assert phrases.without_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automaton_finds_all_occurrences():
    found = phrases.found_by_automaton(["abcabcx", "zz", "xabc", "bcab"], {"abc", "bca", "bc"})
    assert [[(int(a), int(n)) for a, n in zip(*f)] for f in found] == [[(0, 6)], [], [(1, 3)], [(0, 3)]]
    assert len({phrases.letter(i) for i in (0, 0xD7FE, 0xD7FF, 0xFFFF)}) == 4


def test_equal_hashes_are_told_apart(monkeypatch):
    """Windows are confirmed word by word, whatever their hashes."""
    monkeypatch.setattr(phrases, "M1", np.uint64(0))
    words = np.array([1, 2, 3, 1, 2, 4, 5], np.int32)
    assert phrases.recurring(words, np.array([0, 3]), np.array([3, 4]), np.array([1, 1]), 2).tolist() == [0, 3]
