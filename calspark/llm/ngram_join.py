"""N-gram Jaccard join by MinHash banding.

A document is the set of its shingles of five words. BANDS bands of BAND_ROWS minimal hashes each are the keys of a
document: two with similarity s share one with chance 1 - (1 - s^rows)^bands, which is over 0.9996 from 0.8 on.
Documents with the same words are one row with a weight, so exact copies are never paired; candidates come from a
shuffle on band hashes and are verified on their full shingle sets, block by block (bucket_join). Sets are made
only for documents that some bucket needs, in a second pass over the texts (told by a bitmap sized by their
number, of 64 MB at most; beyond 134 million such documents sets are made for all and a join decides).

Defined cases: null text counts as empty; words are runs of letters and digits in lower case; a text of one to four
words is one shingle of all its words; a text without words links with nothing and is a class of its own; a
document is a doc_id: rows that repeat an id count once, with the text of the smallest word hash; rows without an id
get a row without links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_join import TILE, compared, dealt, halves, matrix, owned, tiles
from .components import components
from .shared import bitmap_of, bits_for, cut, documents, grouped, in_bitmap, joined, own_ids, pieces_of
from .words import LETTER, NUMBER, Words, classes, numbers

WORDS = 5
#: Similarity of at least 4/5, compared in whole numbers.
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 20, 5
BATCH_BYTES = 6_000_000
#: Columns of shingles multiplied at a time, and pairs up to which sets are intersected one by one.
COLUMNS, FEW_PAIRS = 4096, 24


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each text."""
    lower = [t.lower() for t in texts]
    whole = "".join(lower)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kind = classes()[points]
    word = (kind == LETTER) | (kind == NUMBER)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    ends = np.cumsum(lengths)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = (ends - lengths)[(lengths > 0)]
    begins[at] = word[at]
    finish = np.append(~word[1:] | begins[1:], True) & word if len(word) else word
    starts, stops = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    data = np.frombuffer(whole.encode(), np.uint8)
    if len(data) != len(points):
        each = np.ones(len(points), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            each += points >= least
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(each, out=offset[1:])
        starts, stops = offset[starts], offset[stops]
    low, high = numbers(Words(data, starts, stops - starts, counts))
    h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (stops - starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32)), counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle, and the number of shingles of each text (with repeats)."""
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    left = np.repeat(np.cumsum(counts), sizes) - at
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = left > k
        h = (h + np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(k)) if len(words) else h) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h, sizes


def bands(h: np.ndarray, sizes: np.ndarray, n_bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """The band hashes of each text that has shingles."""
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    rng = np.random.default_rng(17)
    out = np.zeros((len(full), n_bands), np.uint64)
    for band in range(n_bands):
        key = np.full(len(full), band + 1, np.uint64)
        for _ in range(rows):
            mul, add = (np.uint64(int(x) | 1) for x in rng.integers(1, 2**63 - 1, 2))
            x = (h ^ add) * mul  # the high bits of products mix best: they decide the minimum
            low = np.minimum.reduceat(x, begin) if len(full) else x[:0]
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        out[:, band] = key
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, a 128-bit hash of the words and the band hashes of each text."""
    for batch in pieces_of(batches, "text", BATCH_BYTES):
        words, counts = word_hashes(batch.column("text").to_pylist())
        keys = bands(*(x := shingles(words, counts)))
        ends = np.cumsum(counts)
        digest = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
        both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        lists = np.full(len(counts), None, object)
        lists[np.flatnonzero(x[1])] = [k.tolist() for k in keys]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(lists.tolist(), pa.list_(pa.int64()))], ["doc_id", "size", "d0", "d1", "keys"])


def _sets(bitmap: np.ndarray | None):
    """The shingle sets, sorted, of the documents in a bitmap of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column("h").to_numpy())))
            for part in pieces_of([batch], "text", BATCH_BYTES):
                words, counts = word_hashes(part.column("text").to_pylist())
                h, sizes = shingles(words, counts)
                ends, begins = np.cumsum(counts), np.cumsum(counts) - counts
                digest = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                sets = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(sizes)[:-1])] if len(sizes) else []
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "d0", "d1", "shingles"])

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that have a pair which belongs to its bucket."""
    for tile in grouped(batches, TILE):
        a, b, one = halves(tile)
        if not len(a) or not len(b):
            continue
        keys = matrix(tile.column("keys"))
        pairs = owned(tile.column("table")[0].as_py(), tile.column("key")[0].as_py(), keys[a], keys[b], 1)
        if one:
            np.fill_diagonal(pairs, False)
        on = np.unique(np.concatenate([a[pairs.any(1)], b[pairs.any(0)]]))
        if len(on):
            yield tile.take(pa.array(on))


def _similar(tile: pa.RecordBatch, a: np.ndarray, b: np.ndarray, owned_pairs) -> np.ndarray:
    """Pairs whose shingle sets have a Jaccard similarity of SIMILAR at least."""
    out = owned_pairs()
    column = tile.column("shingles")
    values, offsets = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    begins, sizes = np.cumsum(offsets) - offsets, offsets
    pairs = np.argwhere(np.triu(out, 1) if a is b else out)
    if len(pairs) <= FEW_PAIRS:
        out[:] = False
        for i, j in pairs.tolist():
            x, y = (values[begins[r]: begins[r] + sizes[r]] for r in (a[i], b[j]))
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[i, j] = common * SIMILAR[1] >= SIMILAR[0] * (len(x) + len(y) - common)
        return out
    # a column for each shingle that two rows have at least
    _, of, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[of]
    row = np.repeat(np.arange(tile.num_rows), sizes)
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((tile.num_rows, tile.num_rows), np.float32) if a is b else np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        own = slice(*np.searchsorted(place, [first, first + COLUMNS]))
        part = np.zeros((tile.num_rows, COLUMNS), np.float32)
        part[row[own], place[own] - first] = 1
        common += part @ part.T if a is b else part[a] @ part[b].T
    common = common.astype(np.int64)
    return out & (common * SIMILAR[1] >= SIMILAR[0] * (sizes[a][:, None] + sizes[b][None, :] - common))


def near_documents(df: DataFrame, **blocks: int) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links and kept of every document.

    n_links counts the other documents with a similarity of 0.8 or more, copies included.
    """
    base = documents(df)
    light = cut(base.filter("doc_id IS NOT NULL").mapInArrow(_signed, "doc_id long, size long, d0 long, d1 long, keys array<long>"))
    ids = light.groupBy("doc_id").agg(F.min(F.struct("d0", "d1")).alias("d")).select("doc_id", F.col("d.d0").alias("d0"), F.col("d.d1").alias("d1"))
    groups = cut(ids.groupBy("d0", "d1").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    rows = light.join(groups.withColumnRenamed("id", "doc_id"), ["doc_id", "d0", "d1"]).filter("keys IS NOT NULL").dropDuplicates(["doc_id"])
    rows = cut(rows.select(F.col("doc_id").alias("id"), "size", "d0", "d1", "weight", "keys"))
    pairs = tiles(rows, 1, **blocks).join(rows.select("id", "weight", "keys"), "id")
    schema = "id long, table int, key long, lo int, hi int, block int, weight long, keys array<long>"
    needed = cut(dealt(pairs.select("id", "table", "key", "lo", "hi", "block", "weight", "keys")).mapInArrow(_needed, schema))
    wanted = cut(needed.select(F.xxhash64("id").alias("h")).distinct())
    bitmap = bitmap_of(wanted, "h", bits_for(wanted.count()))
    texts = base.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = texts.mapInArrow(_sets(bitmap), "id long, d0 long, d1 long, shingles array<long>").dropDuplicates(["id", "d0", "d1"])
    sets = sets.join(rows.select("id", "d0", "d1"), ["id", "d0", "d1"], "left_semi").drop("d0", "d1")
    found = cut(compared(needed.join(sets, "id"), _similar, 1))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes_ = groups.join(links, "id", "left").join(roots, "id", "left").join(rows.select("id", F.lit(1).alias("full")), "id", "left")
    classes_ = classes_.select("d0", "d1", "full", "weight", F.coalesce("component", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    out = joined(ids, cut(classes_), ["d0", "d1"], "weight", total).select("doc_id", F.when(F.col("full") == 1, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("full") == 1, F.col("n")).otherwise(0).cast("long").alias("n_links"))
    none = base.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(df: DataFrame, **blocks: int) -> DataFrame:
    """One row of each class, with all its columns; rows that share an id or have none are compared like all others."""
    rows, own = own_ids(df)
    gone = near_documents(rows.select(F.col(own).alias("doc_id"), "text"), **blocks).filter(~F.col("kept")).select(F.col("doc_id").alias(own))
    return rows.join(gone, own, "left_anti").select(*df.columns)
