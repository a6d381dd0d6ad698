"""Byte-level BPE: encoding by ranked merges over the distinct words of a batch, decoding by joining byte pieces.

The fold of ranked merges runs in numpy over all distinct words of an Arrow batch at once. The fold as Spark
higher-order functions with a literal rank map is ``fold_column``; README.md has figures for why it isn't the
main path (a map literal is searched entry by entry, and giving the ids of distinct words back to every place
of every word shuffles several times the input).

Defined cases: null text counts as empty and has no ids; white space belongs to words; special tokens are
ordinary text; words of any length are merged whole; rows of equal id or text are independent.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merges import Merges
from .shared import documents, pieces_of
from .words import distinct, split

#: Bytes of text that a task splits and merges at a time.
BATCH_BYTES = 6_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte pieces of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@functools.cache
def codec(path: str) -> tuple[Merges, np.ndarray, list[bytes]]:
    """The merges of a rank file, the id of each byte, and the bytes of each id."""
    ranks = read_ranks(path)
    merges = Merges((ranks[w[:i]], ranks[w[i:]], r, r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks)
    pieces = [b""] * (max(ranks.values()) + 1)
    for w, r in ranks.items():
        pieces[r] = w
    return merges, np.array([ranks[bytes([b])] for b in range(256)], np.int32), pieces


def encode_words(path: str, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """The ids of each word."""
    merges, byte, _ = codec(path)
    out: list = [None] * len(starts)
    for rows, ids in merges.encoded(data, starts, sizes, byte, byte):
        for w, x in zip(rows.tolist(), ids.tolist(), strict=True):
            out[w] = x
    return out


def encode_batch(path: str, texts: list[str]) -> Iterator[list[int]]:
    """The ids of each text."""
    words = split(texts, keep_spaces=True)
    codes, model = distinct(words)
    ids = encode_words(path, words.data, words.starts[model], words.sizes[model])
    ends = np.cumsum(words.counts).tolist()
    codes = codes.tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield [i for w in codes[a:b] for i in ids[w]]


def decode(path: str, ids: list[int]) -> bytes:
    return b"".join(map(codec(path)[2].__getitem__, ids))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)[2]
        decimal = [b"%d," % i for i in range(len(pieces))]
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            words = split(batch.column("text").to_pylist(), keep_spaces=True)
            codes, model = distinct(words)
            ids = encode_words(path, words.data, words.starts[model], words.sizes[model])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            written = [b"".join(map(decimal.__getitem__, x)) for x in ids]
            decoded = [b"".join(map(pieces.__getitem__, x)) for x in ids]
            ends = np.cumsum(words.counts)
            tokens = np.concatenate([[0], np.cumsum(size[codes])])[np.concatenate([[0], ends])]
            a, b, at = [], [], codes.tolist()
            for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                own = at[i:j]
                a.append(hashlib.sha256(b"".join(map(written.__getitem__, own))[:-1]).hexdigest())
                b.append(hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(tokens)), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(encode_batch(path, batch.column("text").to_pylist())), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(df).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return documents(df).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def fold_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word (binary) by higher-order functions alone, for words of up to a few dozen bytes.

    The literal map has hexadecimal pieces as keys; each step of the fold joins the leftmost pair of lowest rank.
    """
    known = F.create_map(*(x for w, r in ranks.items() for x in (F.lit(w.hex().upper()), F.lit(r))))
    whole = F.hex(word)
    start = F.transform(F.sequence(F.lit(1), F.length(whole), F.lit(2)), lambda i: F.substring(whole, i, F.lit(2)))
    none = F.lit(2**31 - 1)

    def step(pieces: Column, _: Column) -> Column:
        pair = lambda i: F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))
        at = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
        ranked = F.transform(at, lambda i: F.struct(F.when(F.size(pieces) > 1, F.coalesce(F.element_at(known, pair(i)), none)).otherwise(none).alias("rank"), i.alias("at")))
        best = F.array_min(ranked)
        merged = F.concat(F.slice(pieces, F.lit(1), best["at"] - 1), F.array(pair(best["at"])), F.slice(pieces, best["at"] + 2, F.size(pieces)))
        return F.when(best["rank"] < none, merged).otherwise(pieces)

    rounds = F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1)))
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.aggregate(rounds, start, step), lambda p: F.element_at(known, p)))


def joined_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces joined, by higher-order functions."""
    pieces = F.create_map(*(x for w, r in ranks.items() for x in (F.lit(r), F.lit(w.hex().upper()))))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i)), ""))
