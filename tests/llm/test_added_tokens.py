"""Packing takes added tokens inside texts as the library does in its default setting."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from calspark.llm import catalog, packing

pytest.importorskip("public_tokenizers")
TEXTS = [
    "a <|endoftext|> b", "a<|endoftext|>b", "<|EndOfText|>", "<|startoftext|><|endoftext|>", "x<|endoftext", "e<|endoftext|>\u0301 y", "<|<|endoftext|>|>",
    "<|endoftext|>", " \n<|endoftext|>\n ", None, "", "don'<|startoftext|>t", "word " * 70 + "<|endoftext|>" * 70 + "Σ<|startoftext|>",
]


def expected(capacity):
    library = Tokenizer.from_file(catalog.tokenizer("word_bpe_49k.json"))
    out = {}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            out[i, k // capacity] = k, len(ids[k: k + capacity]), zlib.crc32(np.array(ids[k: k + capacity], "<u4").tobytes())
    return out


def found(df):
    return {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in df.collect()}


def test_query_and_stage_equal_the_library(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert found(packing.pack(df, catalog.tokenizer("word_bpe_49k.json"), capacity=64, special=True)) == expected(64)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert found(catalog.op5_packing(spark, str(tmp_path))) == expected(packing.CAPACITY)
    assert found(corpus_pipeline.packed(spark, df, str(tmp_path))) == expected(packing.CAPACITY)
