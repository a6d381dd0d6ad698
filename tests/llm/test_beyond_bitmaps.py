"""Where there are more keys than a bitmap holds, joins decide: the rows are the same. Columns of any name come through."""

import pytest
from pyspark.sql import functions as F

from calspark.llm import exact_dedup, ngram_join, pii, quality, shared, suffix_dedup
from calspark.llm.catalog import tokenizer

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, "a b c"), (2, "abc"), (3, "zz"), (4, "a bc"), (5, None), (6, LONG), (7, LONG + " more"), (8, "q" * 500 + LONG), (9, "r" * 500 + LONG), (10, "x" * 9000), (11, "x" * 9000)]


@pytest.mark.parametrize(("module", "run"), [(exact_dedup, exact_dedup.exact_duplicates), (exact_dedup, exact_dedup.one_of_each), (ngram_join, ngram_join.near_documents), (ngram_join, ngram_join.one_of_each), (suffix_dedup, suffix_dedup.without_repeats)])
def test_same_rows_without_bitmaps(spark, monkeypatch, module, run):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted(map(str, run(df).collect()))
    assert len(want) == len(ROWS) or run.__name__ == "one_of_each"
    for place in (module, shared):
        monkeypatch.setattr(place, "bits_for", lambda keys: None)
    assert sorted(map(str, run(df).collect())) == want


CLASHES = ["row_id", "ROW_ID_", "quality_score", "_quality_score", "h", "size", "keys", "norm", "label", "score", "spans", "own_id", "text_hash", "n"]


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "pii"])
def test_columns_of_any_name_come_through(spark, stage):
    rows = [(d, t, *(f"{c}{i}" for c in CLASHES)) for i, (d, t) in enumerate([*ROWS, (1, "a b c"), (1, "other"), (None, "none")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    run = {"quality": lambda d: quality.accepted(d, labels), "exact": exact_dedup.one_of_each, "near": ngram_join.one_of_each, "pii": pii.redacted}[stage]
    got = run(df)
    assert got.columns == df.columns
    have = {tuple(r)[2:] for r in df.collect()}
    assert {tuple(r)[2:] for r in got.collect()} <= have and (stage == "quality" or got.count() > 5)


def test_packing_of_clashing_names(spark):
    from calspark.llm import packing

    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, length string, sequence_id string").withColumn("part", F.lit(1))
    assert packing.pack(df, tokenizer("word_bpe_49k.json")).count() == 1
