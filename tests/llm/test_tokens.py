import json
import random
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from calspark.llm import byte_bpe, packing, token_counts
from calspark.llm.catalog import tokenizer
from calspark.llm.words import split

public_tokenizers = pytest.importorskip("public_tokenizers")
LETTERS = "abst' \n\t dmlrevRE'' 12é漢́..!Σİß=-"


def texts(n=300, seed=0):
    rnd = random.Random(seed)
    odd = ["", None, " ", "'", "don't 'll x've", "''s", "a" * 700, "=-" * 90, "ΑΣ", "　 a", "x  ", "<|endoftext|>"]
    return odd + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids string")


def test_byte_bpe_equals_the_library(spark):
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts()
    got = {r["doc_id"]: list(r["ids"]) for r in byte_bpe.encode(frame(spark, rows), path).collect()}
    for i, t in enumerate(rows):
        assert got[i] == library.encode_ordinary(t or "")
        assert byte_bpe.decode(path, got[i]) == (t or "").encode()
    digests = byte_bpe.round_trip(frame(spark, rows), path)
    assert {r["doc_id"]: r["n_tokens"] for r in digests.collect()} == {i: len(x) for i, x in got.items()}
    assert byte_bpe.round_trip(frame(spark, []), path).collect() == []


def test_fold_by_higher_order_functions(spark):
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {w: r for w, r in byte_bpe.read_ranks(path).items() if len(w) == 1 or set(w) <= set(b" thanered")}
    few = dict(sorted(ranks.items(), key=lambda x: x[1])[:600])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=few, special_tokens={})
    words = [b"the", b" there", b"ataraneth", b"", b"x"]
    df = spark.createDataFrame([(w,) for w in words], "word binary")
    rows = df.select("word", byte_bpe.fold_column(df["word"], few).alias("ids")).collect()
    assert {bytes(r["word"]): list(r["ids"]) for r in rows} == {w: library.encode_ordinary(w.decode()) for w in words}


def test_word_borders_equal_the_patterns():
    rows = [t or "" for t in texts(2000, 3)]
    for keep, pattern in ((True, public_tokenizers.PATTERN), (False, r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")):
        found = split(rows, keep)
        data = bytes(found.data)
        assert [data[a: a + n].decode() for a, n in zip(found.starts, found.sizes)] == [w for t in rows for w in regex.findall(pattern, t)]


def test_longest_match_counts_equal_brute_force(spark):
    path = tokenizer("word_bpe_49k.json")
    letters, pieces = token_counts.byte_letters(), set()
    for name in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        body, end = (name[:-4], (256,)) if name.endswith("</w>") and len(name) > 4 else (name, ())
        if all(c in letters for c in body):
            pieces.add((*(letters[c] for c in body), *end))
    longest = max(map(len, pieces))

    def greedy(word):
        word, i, n = (*word, 256), 0, 0
        while i < len(word):
            k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i: i + k] in pieces), 1)
            n += word[i: i + k] != (256,)
            i += k
        return n

    rows = [*texts(60, 5), "unbelievable thingtionhe ththing"]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(frame(spark, rows), path).collect()}
    for i, t in enumerate(rows):
        words = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", token_counts.normal(t or ""))
        assert got[i] == (len(words), sum(greedy(w.encode()) for w in words))


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        i = min((i for i, room in enumerate(rooms) if room >= x), key=rooms.__getitem__, default=None)
        if i is None:
            rooms.append(capacity - x)
        else:
            rooms[i] -= x
    return len(rooms)


def test_packing(spark):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = [*texts(120, 7), "one two three " * 200, "a b"]
    got = packing.pack(frame(spark, rows), path, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["length"] for r in own] == [len(ids[k: k + 64]) for k in range(0, len(ids), 64)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[k: k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
        assert [r["start"] for r in own] == [64 * k for k in range(len(own))]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_sequence) <= best_fit_decreasing([r["length"] for r in got], 64)
    assert packing.pack(frame(spark, []), path).collect() == []


@pytest.mark.parametrize("counts", [{}, {5: 3}, {2048: 10, 1: 5}, {1025: 7, 1023: 9}, {300: 10, 200: 7, 100: 3}, {x: x % 7 + 1 for x in range(1, 2049)}])
def test_plans_place_every_piece_once(counts):
    runs, places = packing.plan(counts), {}
    for length, first, count, sequence, offset in runs.tolist():
        for k in range(count):
            places.setdefault(sequence + k, []).append((offset, length, first + k))
    for own in places.values():
        ends = [0, *(o + n for o, n, _ in sorted(own))]
        assert [o for o, *_ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert sorted((n, k) for own in places.values() for _, n, k in own) == sorted((n, k) for n, c in counts.items() for k in range(c))
    assert len(places) <= best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], 2048)


def test_as_few_sequences_as_best_fit(spark):
    """On the given table, the least number that there can be."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(rows, tokenizer("word_bpe_49k.json"), special=True).select("sequence_id", "length").collect()
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 2048)
