"""Personal data: odd and very long texts, and spelled-out spans that the trees should find."""

import random
import time

import pytest

from calspark.llm import pii

from test_models import base

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_addresses_in_long_chains_equal_the_pattern():
    rnd = random.Random(1)
    for _ in range(20000):
        text = "".join(rnd.choice("1.2 .09@+") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == base(text)


@pytest.mark.parametrize(("text", "n"), [
    ("7" * 1_000_000, 0), ("0" * 300_000 + "1.2.3.4", 1), ("0" * 5000 + "300.2.3.4", 0), ("1." * 500_000, 125_000), ("1.2.3.4 " * 100_000, 100_000),
    ("ab@cd.ef " * 100_000, 100_000), ("a@" * 300_000, 0), ("1 " * 400_000, 0), ("+1" * 400_000, 0), ("+1" + "(" * 500_000, 0), ("a." * 400_000 + "@", 0), ("x" * 3_000_000, 0),
])
def test_very_long_texts(trees, text, n):
    started = time.time()
    found, every = pii.found_spans(text, trees)
    assert len(found) == n and set(found) <= set(every)
    assert sum(1 for _ in pii.examples(text[:100_000])) >= 0
    assert time.time() - started < 40


def test_very_long_texts_as_rows(spark):
    rows = [(1, "0" * 5000 + "1.2.3.4", "x"), (1, "0" * 5000 + "1.2.3.4", "x"), (2, "1.2.3.4 " * 5000, "x"), (None, "7" * 50_000, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, r["n_ip"]) for r in pii.spans(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 5000), (3, 0)]
    assert pii.redacted(df).filter("text LIKE '%1.2.3.4%'").count() == 0


def test_overlapping_stretches():
    covered = pii.Covered([("a", 5, 9), ("b", 7, 12), ("c", 20, 22)])
    assert [covered.meets(("x", a, b)) for a, b in ((0, 5), (0, 6), (11, 13), (12, 20), (19, 21), (22, 30))] == [False, True, True, False, True, False]
    covered.add(("x", 12, 14))
    assert covered.meets(("x", 13, 15)) and not covered.meets(("x", 14, 20))


SPELLED = [
    ("email", "{0} (at) {1} (dot) org"), ("email", "{0}[at]{1}[dot]net"), ("email", "{0} at {1} dot com"), ("email", "{0} (AT) {1} (DOT) COM"),
    ("ip", "10[.]20[.]30[.]{2}"), ("ip", "192(.)168(.)7(.){2}"), ("card", "4111.1111.1111.1111"), ("card", "4111/1111/1111/1111"), ("phone", "0049/30/55512{2}9"),
]


def test_spelled_out_spans_are_found(trees):
    """Recall of planted respellings, in texts that hold nothing else, and no span in texts of plain numbers and words."""
    rnd, words = random.Random(2), ["ordinary", "the", "river", "of", "stone", "Weather", "is", "fine,"]
    some = lambda: " ".join(rnd.choice(words) for _ in range(8))
    hit = {kind: [] for kind, _ in SPELLED}
    for i in range(180):
        kind, form = SPELLED[i % len(SPELLED)]
        planted = form.format(rnd.choice(["jane", "j.doe", "info"]), rnd.choice(["example", "site-one", "mailhost"]), rnd.randint(10, 99))
        text = f"{some()} {planted} {some()}"
        at = text.index(planted)
        hit[kind].append(any(a < at + len(planted) and at < b for _, a, b in pii.found_spans(text, trees)[1]))
    recall = {kind: sum(x) / len(x) for kind, x in hit.items()}
    assert recall["email"] >= 0.9 and recall["ip"] >= 0.9 and recall["card"] >= 0.7, recall
    for text in ("see you at noon", "pages 10, 11, 12, 13 and 14", "1 2 3 4 5 6 7 8 9", "on 2024-05-06 at 10.30", "a total of 1234567 of 89", "look at the house. Then go"):
        assert pii.found_spans(f"{some()} {text} {some()}", trees)[1] == []
