import random
import re
from collections import Counter

import pytest

from calspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, number long"


def brute(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x for x, *_ in docs}:
        own = [(s, t) for x, s, t in docs if x == lang]
        df = Counter(t for _, terms in own for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for x, terms in own if x == s for t in terms if t in kept) for s in {s for s, _ in own}}
        every = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = sorted((-sum(f(share(c, t), share(d, t)) for t in kept), o.encode()) for o, d in counts.items() if o != s)
            own_terms = sorted((-f(share(c, t), share(every, t)), t.encode()) for t in kept if c[t] and share(c, t) > share(every, t))[:top]
            for part, found in (("pair", pairs), ("term", own_terms)):
                out += [(lang, s, part, o.decode(), -v, k) for k, (v, o) in enumerate(found, 1)]
    return sorted(map(str, out))


def made(seed):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "Éa", "x", "漢字", "İz", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(None, None, None, None), (1, "", "aa", "only empty"), (2, "123 _ []", "aa", "s1"), (3, "beta\x00beta", None, "s1"), (4, "seldom", "zz", "s1"), (5, "seldom", "zz", "s2")]
    for i in range(160):
        rows.append((10 + i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.randint(0, 30))), rnd.choice(["aa", "bb"]), f"s{rnd.choice([1, 1, 1, 2, 3, 10])}"))
    return [(*r, "clash", 7) for r in rows + rows[20:40]]


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "set_groups": 2}])
def test_equals_brute_force(spark, sizes):
    """Also with vocabularies in many blocks and groups in many sets; hashes deal a block 3 terms on average."""
    rows = made(2)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least_documents=4, top=5, **sizes)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 4, 5)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_do_not_overflow():
    import numpy as np

    counts = np.array([0, 5, 10**13], np.int64)
    assert divergence.shares(counts, 10**13 + 4).tolist() == [1 + 10**9 * (int(c) + 2) // (10**13 + 4) for c in counts]
