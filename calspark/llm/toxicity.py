"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel compares words by the subsequences of three letters that they share: letters may have others between
them, and each letter spanned costs a factor of DECAY, so an insult with letters inserted or left out stays near
itself. Marks and digits inside a word are dropped and single letters in a row are put together before, which
closes the gaps of spelled-out words. The kernel of two sentences is the sum over their distinct words. A word's subsequences
are hashed into DIMENSIONS counts, and kernel values are products of those, scaled to length one. Landmarks are words
of the labelled sentences, those that tell the classes best first, if unlike each other; kernel values to them, whitened by the landmarks'
own kernel matrix, are the features of a sentence, from which a linear hinge-loss model is fitted.

Labels are given for texts, so sentences are learnt as multiple instances: a toxic text has toxic ones, a clean
one has none. An instance is LONGEST words in a row of a sentence, beginning at each of its words, so no two neighbours are
ever apart; longer instances were tried on the texts held back and drown an insult in the words around it. The evidence of the
landmarks (log-likelihood ratios of their counts) points out the WORST instances of each text first; models are then
fitted to what is pointed out, ROUNDS times, and each points out the worst ones anew. Instances of toxic texts
that are like the worst of clean texts teach nothing in a round, but are judged again in the next; those of clean texts are kept from all
rounds. Every word of every labelled text takes part. As features and model are linear in the hashed counts, both fold into one weight for each
count, and a distinct word of a batch costs a few look-ups. The margin of a text is the mean of its TOP worst
instances; its chance is calibrated on the third of the labelled texts that was held back. All settings were chosen on that
third, never on rows held out.

Labelled texts are a bounded sample (TRAIN_ROWS, those with the smallest hashes of doc_id).

Defined cases: null text counts as empty; an empty sentence belongs to every text, so texts without letters have its
score; without labels of both classes the score is 0.5 for all; doc_id null is held out; repeated rows each get a
row, and the one of smallest text is learnt from; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import calibration, chance, dual_coordinate_descent
from .quality import remainder, training_rows
from .shared import cut, documents, pieces_of, ragged, width
from .words import LETTER, SPACE, Words, classes, distinct

TRAIN_ROWS = 6000
DIMENSIONS = 1 << 18
DECAY = 0.6
#: Letters from the first to the last of a subsequence, at most.
SPAN = 6
LANDMARKS = 240
#: Words of most evidence that landmarks are chosen from, and the kernel value from which two are too near to both be one.
CANDIDATES, NEAR = 1500, 0.7
#: Words of an instance, at most, and from where one begins to where the next does.
LONGEST, STRIDE = 2, 1
#: Models fitted one after the other, and the worst instances of a text that each is fitted to.
ROUNDS, WORST = 3, 5
#: Instances whose mean margin is that of a text.
TOP = 2
#: Share of the worst instances of clean texts that one of a toxic text has to exceed to be learnt from.
TYPICAL = 0.98
COST = 1.0
BATCH_BYTES = 6_000_000
#: End a sentence where white space follows.
ENDS = [ord(c) for c in ".!?;:\n。！？"]
#: Stand for a word's begin and end in its subsequences.
BEGIN, END = 2, 3
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def letter_words(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of each text as letters alone (single letters in a row as one word), their code points, their sentences."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le"), "<u4")
    kind = classes()[points]
    doc = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    after_space = np.append(kind[1:] == SPACE, True)
    ends = np.cumsum(np.isin(points, ENDS) & after_space) + doc if len(points) else doc
    kept = (kind == LETTER) | (kind == SPACE)
    letter, points, doc, ends = kind[kept] == LETTER, points[kept], doc[kept], ends[kept]
    if not letter.any():
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, np.zeros(len(lower), np.int64)), np.zeros((0, 2), np.int64), empty
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | (doc[1:] != doc[:-1])
    rank = np.cumsum(letter) - 1
    starts = rank[begins]
    letters, owner, ends = points[letter], doc[begins], ends[begins]
    sizes = np.diff(np.append(starts, len(letters)))
    single = sizes == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    starts, owner, ends = starts[~joined], owner[~joined], ends[~joined]
    sizes = np.diff(np.append(starts, len(letters)))
    each = np.ones(len(letters), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        each += letters >= least
    offset = np.zeros(len(letters) + 1, np.int64)
    np.cumsum(each, out=offset[1:])
    data = np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8)
    words = Words(data, offset[starts], offset[starts + sizes] - offset[starts], np.bincount(owner, minlength=len(lower)))
    return words, np.stack([starts, sizes], 1), ends


def instances(owner: np.ndarray, sentence: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, instance) for the distinct words of each instance, and the text of each.

    An instance is a whole sentence, or, of a longer one, LONGEST words in a row; these begin every STRIDE words, so they overlap.
    """
    n = len(owner)
    new = np.ones(n, bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    size = np.diff(np.append(first, n))
    number = 1 + np.maximum(-(-(size - LONGEST) // STRIDE), 0)
    base = np.cumsum(number) - number
    before = np.full(n, -1, np.int64)  # the same word before in the sentence
    order = np.lexsort((np.arange(n), codes, of))
    again = (codes[order][1:] == codes[order][:-1]) & (of[order][1:] == of[order][:-1])
    before[order[1:][again]] = order[:-1][again]
    step = (np.arange(n) - first[of]) // STRIDE
    words, found = [], []
    for back in range(LONGEST // STRIDE):
        k = step - back
        on = np.flatnonzero((k >= 0) & (k < number[of]) & (before < first[of] + k * STRIDE))
        words.append(on)
        found.append(base[of[on]] + k[on])
    return np.concatenate(words), np.concatenate(found), np.repeat(owner[first], number)


def subsequences(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, hash, weight) of every subsequence, by its gaps."""
    inner, sizes = sizes, sizes + 2
    word = np.repeat(np.arange(len(starts)), sizes)
    begin = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), END, np.uint64)
    flat[begin] = BEGIN
    flat[ragged(begin + 1, inner)] = letters[ragged(starts, inner)]
    left = np.repeat(sizes, sizes) - (np.arange(len(flat)) - np.repeat(begin, sizes))
    mixed = [flat * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    for j, k in STEPS:
        at = np.flatnonzero(left > k)
        h = mixed[0][at] ^ (mixed[1][at + j] >> np.uint64(1)) ^ (mixed[2][at + k] >> np.uint64(2))
        h *= np.uint64(0xD6E8FEB86659FD93)
        yield word[at], ((h >> np.uint64(40)) % np.uint64(DIMENSIONS)).astype(np.int64), DECAY ** (k - 2)


@dataclass
class Model:
    """Margin of a sentence = bias + the sum of its distinct words' (their counts, scaled to length one) * weights."""

    weights: np.ndarray
    bias: float = 0.0
    a: float = 0.0
    b: float = 0.0

    def of_words(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, square = np.zeros(len(starts)), np.zeros(len(starts))
        for word, h, weight in subsequences(letters, starts, sizes):
            total += np.bincount(word, self.weights[h], len(starts)) * weight
            square += np.bincount(word, minlength=len(starts)) * weight**2
        return np.where(square > 0, total / np.sqrt(np.maximum(square, 1e-12)), 0.0)

    def of_sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The margins of all sentences, and the text of each."""
        words, places, sentence = letter_words(texts)
        if not len(places):
            return np.zeros(0), np.zeros(0, np.int64)
        codes, model = distinct(words)
        word, instance, doc = instances(np.repeat(np.arange(len(texts)), words.counts), sentence, codes)
        points = np.frombuffer(bytes(words.data).decode().encode("utf-32-le"), "<u4")
        margins = self.of_words(points, places[model, 0], places[model, 1])[codes]
        return np.bincount(instance, margins[word], len(doc)) + self.bias, doc

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """The mean margin of the TOP worst instances of each text; empty ones stand in where there are fewer."""
        margins, doc = self.of_sentences(texts)
        order = np.lexsort((-margins, doc))
        margins, doc = margins[order], doc[order]
        top = np.arange(len(doc)) - np.searchsorted(doc, doc) < TOP
        n = np.bincount(doc[top], minlength=len(texts))
        return (np.bincount(doc[top], margins[top], len(texts)) + (TOP - n) * self.bias) / TOP


def counts_of(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed subsequences of each word and their values, scaled to length one as in ``Model.margins``."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    parts = list(subsequences(letters, np.cumsum(sizes) - sizes, sizes))
    word = np.concatenate([p[0] for p in parts])
    h, v = np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    order = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[order], np.arange(1, len(words)))
    return [(a, b / max(np.sqrt(b @ b), 1e-12)) for a, b in zip(np.split(h[order], bounds), np.split(v[order], bounds), strict=True)]


def kernel(counts: list[tuple[np.ndarray, np.ndarray]], landmarks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Kernel values of words to landmarks."""
    table, out = np.zeros(DIMENSIONS), np.zeros((len(counts), len(landmarks)))
    index = np.repeat(np.arange(len(counts)), [len(h) for h, _ in counts])
    every = np.concatenate([h for h, _ in counts]) if counts else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in counts]) if counts else np.zeros(0)
    for i, (h, v) in enumerate(landmarks):
        np.add.at(table, h, v)
        out[:, i] = np.bincount(index, table[every] * values, len(counts))
        table[h] = 0
    return out


def words_of(text: str) -> list[str]:
    words, places, _ = letter_words([text])
    letters = bytes(words.data).decode()
    return [letters[a: a + n] for a, n in places.tolist()]


def sentences_of(text: str) -> list[list[str]]:
    """The distinct words of each instance."""
    words, places, sentence = letter_words([text])
    if not len(places):
        return []
    letters = bytes(words.data).decode()
    word, instance, doc = instances(np.zeros(len(places), np.int64), sentence, distinct(words)[0])
    out: list[list[str]] = [[] for _ in doc]
    for i, k in zip(word.tolist(), instance.tolist(), strict=True):
        a, n = places[i].tolist()
        out[k].append(letters[a: a + n])
    return out


class Landmarks:
    """Hashed counts of the landmark words, and what makes kernel values to them features of unit covariance."""

    def __init__(self, words: list[str]):
        self.counts = counts_of(words)
        values, vectors = np.linalg.eigh(kernel(self.counts, self.counts))
        keep = values > 1e-3
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, words: list[str]) -> np.ndarray:
        """Of the sentence of these words; the last one is the bias."""
        table = np.zeros(DIMENSIONS)
        for h, v in counts_of(sorted(set(words))) if words else []:
            np.add.at(table, h, v)
        return np.append(np.array([table[h] @ v for h, v in self.counts]) @ self.whiten, 1.0)

    def folded(self, alpha: np.ndarray, bias: float = 0.0) -> Model:
        """Kernel values to the landmarks times alpha, as weights of hashed counts."""
        weights = np.zeros(DIMENSIONS)
        for (h, v), x in zip(self.counts, alpha, strict=True):
            np.add.at(weights, h, v * x)
        return Model(weights, bias)

    def fitted(self, toxic: np.ndarray, clean: np.ndarray) -> Model:
        """The hinge-loss model of feature rows; clean rows have the same total cost as toxic ones at most fourfold."""
        rows = [(slice(None), r) for r in (*toxic, *clean)]
        label = np.array([1] * len(toxic) + [-1] * len(clean))
        cost = COST * np.where(label > 0, max(1.0, len(clean) / max(len(toxic), 1) / 4), 1.0)
        w = dual_coordinate_descent(rows, label, self.whiten.shape[1] + 1, cost, epochs=15)
        return self.folded(self.whiten @ w[:-1], float(w[-1]))


def worst(model: Model | dict[str, float], text: str, most: int = WORST) -> list[tuple[float, list[str]]]:
    """The instances with the greatest margins, or with the words of most evidence, the first of equals; an empty one of a text without words."""
    sentences = sentences_of(text)
    if not sentences:
        return [(model.bias if isinstance(model, Model) else 0.0, [])]
    if isinstance(model, Model):
        values = model.of_sentences([text])[0]
    else:
        values = np.array([max(model.get(w, 0.0) for w in own) for own in sentences])
    return [(float(values[i]), sentences[i]) for i in np.argsort(-values, kind="stable")[:most]]


def unlike_each_other(words: list[str], most: int) -> list[int]:
    """The first words, as many as asked for, that are not near to a word before them, then the first others."""
    if not words:
        return []
    counts = counts_of(words)
    near = kernel(counts, counts) > NEAR
    picked: list[int] = []
    for i in range(len(words)):
        if len(picked) < most and not near[i, picked].any():
            picked.append(i)
    return sorted(picked + [i for i in range(len(words)) if i not in set(picked)][: most - len(picked)])


def landmark_words(sample: DataFrame, total: Counter) -> dict[str, float]:
    """The words of the labelled texts that tell toxic ones best, the most frequent of others, and some at random, with the evidence of the first."""

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lists, pa.list_(pa.string()))], ["label", "words"])

    words = sample.mapInArrow(worded, "label int, words array<string>").select("label", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("n"), F.sum(1 - F.col("label")).alias("m"))
    share = total[1] / (total[0] + total[1])
    part = lambda k, s: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (F.col("n") + F.col("m")) / s)).otherwise(0.0)
    counts = cut(counts.withColumn("evidence", part("n", share) + part("m", 1 - share)).withColumn("toxic", F.col("n") > share * (F.col("n") + F.col("m"))))
    some = LANDMARKS // 8
    picked = [(counts.filter("toxic"), [F.desc("evidence"), "word"], CANDIDATES), (counts.filter("NOT toxic"), [F.desc("m"), "word"], some), (counts, [F.xxhash64("word"), "word"], some)]
    best, *others = [rows.orderBy(*order).limit(most).collect() for rows, order, most in picked]
    unlike = [best[i] for i in unlike_each_other([r["word"] for r in best], LANDMARKS - 2 * some)]
    found = {r["word"]: r["evidence"] if r["toxic"] else 0.0 for rows in (unlike, *others) for r in rows}
    return {w: x / max(1e-9, *found.values(), 0.0) for w, x in sorted(found.items())}


def fit(df: DataFrame, labels: DataFrame, learnt_from: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the rows of ``labels.toxic`` for which ``learnt_from`` holds, train_rows at most.

    The driver gets ids and labels, CANDIDATES words, and in each round the features of WORST instances of each row.
    """
    sample = cut(training_rows(df, labels, "toxic", learnt_from, train_rows).select("doc_id", "label", "text").repartition(width(df), "doc_id"))
    rows = sample.select("doc_id", "label").collect()  # train_rows at most
    back = {r["doc_id"] for r in rows if zlib.crc32(b"%d back" % r["doc_id"]) % 3 == 0}
    total = Counter(r["label"] for r in rows if r["doc_id"] not in back)
    if len(total) < 2:
        return Model(np.zeros(DIMENSIONS))
    ids = df.sparkSession.createDataFrame([(r["doc_id"], r["doc_id"] in back) for r in rows], "doc_id long, back boolean")
    sample = cut(sample.join(F.broadcast(ids), "doc_id"))
    learnt = sample.filter("NOT back")
    evidence = landmark_words(learnt, total)
    landmarks = Landmarks(list(evidence))
    model, hard = evidence, None

    def pointed_out(model: Model | dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the worst instances of toxic texts, those that are no typical ones, and of clean texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [worst(model, t) for t in batch.column("text").to_pylist()]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(own) for own in found]))
                every = [x for own in found for x in own]
                values = [landmarks.features(own).astype(np.float32).tobytes() for _, own in every]
                columns = [batch.column("doc_id").take(at), batch.column("label").take(at), pa.array([v for v, _ in every], pa.float64()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "value", "features"])

        found = sorted(learnt.mapInArrow(run, "doc_id long, label int, value double, features binary").collect(), key=lambda r: (r["doc_id"], -r["value"], r["features"]))
        x, y, value = np.array([np.frombuffer(r["features"], np.float32) for r in found], np.float64), np.array([r["label"] for r in found]), np.array([r["value"] for r in found])
        telling = value > np.quantile(value[y == 0], TYPICAL)
        return x[(y == 1) & telling] if (telling & (y == 1)).any() else x[y == 1], x[y == 0]

    for _ in range(ROUNDS):
        toxic, clean = pointed_out(model)
        hard = clean if hard is None else np.unique(np.concatenate([hard, clean]), axis=0)
        model = landmarks.fitted(toxic, hard)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.of_texts(batch.column("text").to_pylist()))], ["label", "value"])

    known = sample.filter("back").mapInArrow(valued, "label int, value double").collect()
    model.a, model.b = calibration(np.array([r["value"] for r in known]), np.array([r["label"] for r in known])) if len({r["label"] for r in known}) > 1 else (1.0, 0.0)
    return model


def held_out() -> Column:
    return F.coalesce(remainder(5) == 0, F.lit(True))


def toxicity(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(df, labels, ~held_out(), train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            found = chance(model.of_texts(batch.column("text").to_pylist()), model.a, model.b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    found = documents(df).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
