"""The stages keep one row of each class, also where ids are null or repeated."""

from collections import Counter

from calspark.llm import exact_dedup, ngram_join

SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG + " more"
OTHER = " ".join(f"thing{i}" for i in range(60))


def test_exact_copies(spark):
    rows = [
        (None, "a copy", "x"), (None, "a  copy", "x"), (None, "a copy", "x"), (None, "alone", "x"),  # copies without an id
        (3, "same row", "x"), (3, "same row", "x"),  # a repeated row
        (4, "first", "x"), (9, "first", "x"), (9, "unique", "x"),  # two texts of one id, one of them a copy
        (10, None, "x"), (11, " ", "x"), (12, "plain", "x"),
    ]
    got = exact_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["text"] or "").replace(" ", "") for r in got) == Counter(["acopy", "alone", "samerow", "first", "unique", "", "plain"])
    assert (None, "a  copy", "x") in [tuple(r) for r in got]  # the longest stays
    assert (4, "first", "x") in [tuple(r) for r in got]


def test_near_copies(spark):
    rows = [(None, LONG, "x"), (None, NEAR, "x"), (2, OTHER, "x"), (2, LONG + " again", "x"), (7, OTHER + " more", "x"), (7, OTHER, "y"), (8, "", "x"), (None, "", "x")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["text"] or "-")[:4] for r in got) == Counter({"word": 1, "thin": 1, "-": 2})


def test_ids_at_the_end_of_the_range(spark):
    rows = [(2**63 - 1, "a", "x"), (2**63 - 1, "b", "x"), (None, "a", "x"), (5, "c", "x")]
    assert sorted(r["text"] for r in exact_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()) == ["a", "b", "c"]
