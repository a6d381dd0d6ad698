"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams (1 to 3) of word shapes and of words (1 and 2). A word's shape is case, size and
whether the word is repeated right away; marks and digits stay what they are. Indicators are scaled by the log-count
ratio of the classes (counted without the row itself where a row is learnt from), those of shapes and those of words
to length one, and a linear hinge-loss model is fitted to them by dual coordinate descent. The model is fitted
on the driver from a bounded sample of labelled rows (TRAIN_ROWS and TRAIN_BYTES, those with the smallest hashes of doc_id); a third of
them is held back, and margins are calibrated to chances on these. Features of fewer than three sampled rows count nothing. Scoring is one pass without a shuffle.

Defined cases: null text counts as empty, and an empty text has a score (that of no feature); without labels of
both classes the score is 0.5 for all; doc_id null is held out; repeated rows each get a row; repeated labels of
an id count once (the greatest), as do rows that repeat an id (the smallest text); texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import calibration, chance, dual_coordinate_descent
from .shared import cut, documents, free_name, pieces_of, smallest_hashes
from .words import Words, distinct, numbers, split

TRAIN_ROWS = 6000
#: Bytes of features (four each) that the driver takes: rows with the smallest hashes of doc_id first.
TRAIN_BYTES = 256_000_000
#: Hashed n-grams of shapes, then as many of words.
DIMENSIONS = 1 << 16
SHAPES, WORDS = 3, 2
SMOOTHING = 1.0
COST = 1.0
BATCH_BYTES = 1_500_000


@dataclass
class Model:
    """Margin = bias + sum of the weights of a text's features; chance = 1 / (1 + exp(-(a * margin + b)))."""

    weights: np.ndarray
    bias: float = 0.0
    a: float = 0.0
    b: float = 0.0


def shapes(words: Words) -> np.ndarray:
    """A number for the shape of each word."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    upper = lambda at: ((data[at] >= 65) & (data[at] <= 90)) | ((data[at] == 0xC3) & (data[at + 1] >= 0x80) & (data[at + 1] <= 0x9E))
    first = data[words.starts]
    letters = ((first | 32) >= 97) & ((first | 32) <= 122) | (first >= 0x80)
    last = words.starts + words.sizes - 1
    ends_upper = ((data[last] >= 65) & (data[last] <= 90)) | ((data[np.maximum(last - 1, 0)] == 0xC3) & (data[last] <= 0x9E))
    case = upper(words.starts).astype(np.uint64) * np.uint64(2) + (ends_upper & (words.sizes > 1))
    size = np.searchsorted([2, 3, 5, 9, 17], words.sizes, side="right").astype(np.uint64)
    codes, _ = distinct(words)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    again = np.zeros(len(codes), bool)
    for back in (1, 2):
        again[back:] |= (codes[back:] == codes[:-back]) & (doc[back:] == doc[:-back])
    literal = data[words.starts[:, None] + np.arange(3)].astype(np.uint64) @ np.array([1, 256, 65536], np.uint64)
    literal = np.where(words.sizes < 2, literal & np.uint64(0xFF), np.where(words.sizes < 3, literal & np.uint64(0xFFFF), literal))
    return np.where(letters, case * np.uint64(64) + size * np.uint64(4) + again, literal * np.uint64(1024) + np.uint64(1023))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every feature that a text has, once each, in any order."""
    words = split(texts, keep_spaces=False)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    low, high = numbers(words) if len(words.starts) else (np.zeros(0, np.uint64),) * 2
    word = low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    keys = [doc[: len(h)][same] * (2 * DIMENSIONS) + first + (h[same] % np.uint64(DIMENSIONS)).astype(np.int64)
            for first, values, most in ((0, shapes(words), SHAPES), (DIMENSIONS, word, WORDS)) for h, same in grams(values, doc, most)]
    import pandas as pd

    found = pd.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found // (2 * DIMENSIONS), found % (2 * DIMENSIONS)


def scales(doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """What the indicators of each text are multiplied by, those of shapes and those of words: one over the root of their number."""
    n = np.bincount(doc * 2 + (feature >= DIMENSIONS), minlength=2 * n).reshape(n, 2)
    return 1 / np.sqrt(np.maximum(n, 1))


def grams(values: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams that start at each place, and whether they lie in one text."""
    mixed = np.zeros(len(values), np.uint64)
    for n in range(1, min(most, len(values)) + 1):
        mixed = (mixed[: len(values) - n + 1] + values[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        yield mixed, doc[: len(mixed)] == doc[n - 1:]


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo so much."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def training_rows(df: DataFrame, labels: DataFrame, label: str, learnt: Column, rows: int) -> DataFrame:
    """doc_id, text and label of at most so many labelled rows for which ``learnt`` holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & learnt)
    known = smallest_hashes(known.groupBy("doc_id").agg(F.max("label").alias("label")), rows, "doc_id")
    own = documents(df).join(F.broadcast(known), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(df: DataFrame, labels: DataFrame, learnt: Column, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model from the rows of ``labels.quality`` for which ``learnt`` holds, train_rows and train_bytes of features at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            doc, feature = features(batch.column("text").to_pylist())
            feature, doc = feature[np.argsort(doc, kind="stable")], np.sort(doc)
            lists = [x.astype("<i4").tobytes() for x in np.split(feature, np.searchsorted(doc, np.arange(1, batch.num_rows)))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.binary())], ["doc_id", "label", "features"])

    sample = training_rows(df, labels, "quality", learnt, train_rows).mapInArrow(run, "doc_id long, label int, features binary")
    # train_rows sizes at most, then the features that TRAIN_BYTES have room for
    sample = cut(sample)
    sizes = sample.select("doc_id", F.octet_length("features").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room = np.cumsum([r["bytes"] for r in sizes]) <= train_bytes
    if not room.all():
        sample = sample.join(F.broadcast(df.sparkSession.createDataFrame([(r["doc_id"],) for r, fits in zip(sizes, room, strict=True) if fits], "doc_id long")), "doc_id")
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    back = np.array([zlib.crc32(b"%d back" % r["doc_id"]) % 3 == 0 for r in rows], bool)
    y = np.array([r["label"] for r in rows], int)
    if len(set(y[~back].tolist())) < 2 or len(set(y[back].tolist())) < 2:
        return Model(np.zeros(2 * DIMENSIONS))
    at = [np.frombuffer(r["features"], "<i4") for r in rows]
    counts = [np.full(2 * DIMENSIONS, SMOOTHING) for _ in (0, 1)]
    for a, label, held in zip(at, y.tolist(), back.tolist(), strict=True):
        if not held:
            counts[label][a] += 1
    total = [c.sum() for c in counts]
    seldom = counts[0] + counts[1] < 2 * SMOOTHING + 3  # seen too seldom to tell
    ratio = np.where(seldom, 0, np.log(counts[1] / total[1]) - np.log(counts[0] / total[0]))
    sparse = []
    for a, label, held in zip(at, y.tolist(), back.tolist(), strict=True):
        telling, scale = a[~seldom[a]], scales(np.zeros(len(a), np.int64), a, 1)[0]
        # a row that was counted is left out of its own ratios: a word of one text alone would tell its label
        own = [counts[k][telling] - (not held and label == k) for k in (0, 1)]
        values = np.log(own[1] / total[1]) - np.log(own[0] / total[0])
        sparse.append((np.append(telling, np.int32(2 * DIMENSIONS)), np.append(values * scale[(telling >= DIMENSIONS).astype(int)], 1.0).astype(np.float32)))
    learnt_rows, known = np.flatnonzero(~back), y[~back]
    share = known.mean()
    w = dual_coordinate_descent([sparse[i] for i in learnt_rows], 2 * known - 1, 2 * DIMENSIONS + 1, COST * np.where(known == 1, 0.5 / share, 0.5 / (1 - share)))
    held = np.array([float(w[sparse[i][0]] @ sparse[i][1]) for i in np.flatnonzero(back)])
    return Model(w[:-1] * ratio, float(w[-1]), *calibration(held, y[back]))


def score(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of ``df`` with their score (0 to 1) as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            doc, feature = features(batch.column("text").to_pylist())
            scale = scales(doc, feature, batch.num_rows)[doc, (feature >= DIMENSIONS).astype(np.int64)] if len(doc) else np.zeros(0)
            margin = np.bincount(doc, model.weights[feature] * scale, batch.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance(margin, model.a, model.b))], [*batch.schema.names, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, `{name}` double")


def held_out() -> Column:
    return F.coalesce(remainder(3) == 1, F.lit(True))


def quality(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(df, labels, ~held_out(), train_rows)
    found = score(documents(df), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``df``, with all their columns, that the model takes for good; a null text comes back empty."""
    model, own = fit(df, labels, ~held_out(), train_rows), free_name(df, "quality_score")
    found = score(df.withColumn("text", F.coalesce(F.col("text"), F.lit(""))), model, own)
    return found.filter(F.col(own) >= 0.5).drop(own)
