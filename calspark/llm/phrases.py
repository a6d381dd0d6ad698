"""Removing repeated passages of words by automata of recurring phrases.

A window is WINDOW words in a row; a window whose words start at another place too is repeated, and all its words go.

1. Anchors. The least hash of GRAM words in a window is its anchor: equal windows have equal anchors. Windows in a row with
   the same anchor make a stretch. Anchors that occur once can't belong to a repeated window; a bitmap of the others, sized by
   their number and of 64 MB at most, spares most stretches the next shuffle (beyond 134 million anchors all go there).
2. Stretches with a noted anchor, without their words: equal ones (by a cryptographic digest of 128 bits) are one with a count and one
   place. Anchors with very many stretches that differ (a common line in changing surroundings) are taken apart
   into single windows, so that no anchor's stretches exceed what a shard holds.
3. The words of each distinct stretch are read at its place and go to the shard of its anchor. There windows that recur are confirmed
   word by word, and the passages that they make up are the phrases of an Aho-Corasick automaton over
   word numbers. All stretches of the shard are streamed through it; what it finds are the repeated words.
4. What is found in a stretch holds at all its places. These are joined with the texts, and the words are cut out.

So every stretch of every document that can hold a repeated window passes through the automaton of its shard, once for equal
ones, and no other automaton needs to see it, as equal windows have equal anchors.

Defined cases: null text has no words; texts with fewer than WINDOW words lose nothing; windows never cross documents but may
overlap and may be within one; repeated rows are places of their own; texts and words of any length are read whole; a null doc_id is an
id like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MOST_BITS, bitmap_of, bits_for, cut, documents, grouped, in_bitmap, joined, pieces_of, ragged, width, with_rows
from .suffix_dedup import M1, anchored, digests, doubled, runs_of

WINDOW, GRAM = 35, 8
#: Words of a shard, about.
SHARD_WORDS = 300_000
#: Stretches of an anchor that are compared in one shard, at most.
HOT_STRETCHES = 2048
BATCH_BYTES = 2_000_000
SPACE = 32
#: A number for each byte, and a base, for hashes of words.
LETTERS = np.random.default_rng(35).integers(1, 2**63, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """Texts as words with one space behind each: their bytes, each word's first byte and end, each text's number of words."""

    def __init__(self, texts: list[bytes]):
        parts = [b" ".join(t.split()) for t in texts]
        self.data = b"".join([p + b" " for p in parts if p])
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.ends = np.flatnonzero(self.bytes == SPACE)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.counts = np.fromiter((p.count(b" ") + 1 if p else 0 for p in parts), np.int64, len(parts))
        self.begins = np.cumsum(self.counts) - self.counts

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts + 1
        powers = np.full(int(sizes.max()), BASE, np.uint64).cumprod()
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, sizes)
        h = np.add.reduceat(LETTERS[self.bytes] * powers[place], self.starts)
        h ^= h >> np.uint64(32)
        return h * M1

    def between(self, first: int, stop: int) -> bytes:
        """The words from one place to another, with single spaces between them."""
        return self.data[self.starts[first]: self.ends[stop - 1]]


class Stretches:
    """Windows in a row with the same anchor: text, first word, number of windows, anchor, digest, whether one may be there twice."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        words = Text(texts)
        h, length = words.hashes(), 1
        while length < gram:
            h = doubled(h, length)
            length *= 2
        if length != gram:
            raise ValueError("gram has to be a power of two")
        starts = np.maximum(words.counts - window + 1, 0)
        self.words, self.window = words, window
        self.text, self.at, self.count, self.anchor, self.multi = anchored(h, words.begins, starts, window - gram + 1) if starts.any() else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        self.digest = self._digests(self.at, self.count)

    def _digests(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return digests(self.words.data, self.words.starts[at], self.words.ends[at + count + self.window - 2]) if len(at) else np.zeros((0, 2), np.int64)

    def only(self, on: np.ndarray) -> None:
        self.text, self.at, self.count, self.anchor, self.multi, self.digest = (x[on] for x in (self.text, self.at, self.count, self.anchor, self.multi, self.digest))

    def apart(self, hot: np.ndarray) -> None:
        """The stretches that are hot become single windows, each with its own digest for an anchor."""
        rows = np.flatnonzero(hot)
        each = ragged(self.at[rows], self.count[rows])
        one = np.ones(len(each), np.int64)
        digest = self._digests(each, one)
        text = np.repeat(self.text[rows], self.count[rows])
        self.only(~hot)
        self.text, self.at, self.count = np.append(self.text, text), np.append(self.at, each), np.append(self.count, one)
        self.anchor, self.multi, self.digest = np.append(self.anchor, digest[:, 0]), np.append(self.multi, one == 0), np.concatenate([self.digest, digest])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [bytes(x.as_buffer()) for x in batch.column("text")]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            s = Stretches(_bytes(batch), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor), pa.array(s.digest[:, 0].copy()), pa.array(s.multi)], ["anchor", "d0", "multi"])

    return run


PLACES = "doc_id long, text_hash long, first long, count long, anchor long, d0 long, d1 long, multi boolean"


def _noted(repeated: np.ndarray | None, hot: np.ndarray, window: int, gram: int):
    """The places of stretches whose anchor is in the bitmap; those of hot anchors window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            s = Stretches(_bytes(batch), window, gram)
            s.only(np.flatnonzero(in_bitmap(repeated, s.anchor)))
            s.apart(in_bitmap(hot, s.anchor))
            rows = pa.array(s.text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(s.at - s.words.begins[s.text]), pa.array(s.count), pa.array(s.anchor), pa.array(s.digest[:, 0].copy()), pa.array(s.digest[:, 1].copy()), pa.array(s.multi)],
                [c.split()[0] for c in PLACES.split(", ")],
            )

    return run


def _words_at(window: int):
    """The words of the stretches that were chosen in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            words = Text(_bytes(batch))
            chosen = batch.column("chosen")
            of = np.repeat(np.arange(batch.num_rows), np.diff(chosen.offsets.to_numpy()))
            own = dict(zip(("first", "count", "shard", "d0", "d1", "n"), chosen.flatten().flatten(), strict=True))
            first = words.begins[of] + own["first"].to_numpy()
            body = [words.between(a, b) for a, b in zip(first.tolist(), (first + own["count"].to_numpy() + window - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(own[c] for c in ("shard", "d0", "d1", "n")), pa.array(body, pa.binary())], ["shard", "d0", "d1", "n", "body"])

    return run


def recurring(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """The first words of all windows that are there twice, or in a stretch that has copies."""
    at = ragged(begins, sizes - window + 1)
    weight = np.minimum(np.repeat(copies, sizes - window + 1), 2)
    h = np.zeros(len(at), np.uint64)
    for k in range(window):
        h = (h ^ words[at + k].astype(np.uint64)) * M1
        h ^= h >> np.uint64(29)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    model = at[first[of]]
    if any((words[at + k] != words[model + k]).any() for k in range(window)):  # equal hashes of different windows
        _, of = np.unique(words[at[:, None] + np.arange(window)], axis=0, return_inverse=True)
        of = of.ravel()
    return at[np.bincount(of, weight)[of] > 1]


def letter(number: int) -> str:
    """A word's number as a character (surrogates are left out)."""
    return chr(number + 1 if number + 1 < 0xD800 else number + 0x801)


def found_by_automaton(texts: list[str], phrases: set[str]) -> list[tuple[int, int]]:
    """Text, and the stretches (first, end) that phrases cover, of all texts."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(phrase)
    automaton.make_automaton()
    out = []
    for text in texts:
        reach = np.zeros(len(text) + 1, np.int32)
        for end, length in automaton.iter(text):
            reach[end - length + 1] += 1
            reach[end + 1] -= 1
        out.append(runs_of(np.flatnonzero(np.cumsum(reach)[:-1])))
    return out


def _shards(window: int):
    """Digest and covered words (first, count) of each stretch that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in grouped(batches, ["shard"]):
            d0, d1, copies = (shard.column(c).to_numpy() for c in ("d0", "d1", "n"))
            _, one = np.unique(np.rec.fromarrays([d0, d1]), return_index=True)  # a row that is there twice brings its words twice
            number: dict[bytes, int] = {}
            bodies = [[number.setdefault(w, len(number)) for w in shard.column("body")[i].as_py().split(b" ")] for i in one.tolist()]
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            begins = np.cumsum(sizes) - sizes
            words = np.fromiter((w for body in bodies for w in body), np.int32, int(sizes.sum()))
            first, count = runs_of(recurring(words, begins, sizes, copies[one], window))
            letters = [letter(i) for i in range(len(number))]
            whole = "".join([letters[w] for w in words.tolist()])
            # windows of neighbours never follow each other, as the last ones of a stretch hold its end
            phrases = {whole[a: a + n + window - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)}
            if not phrases:
                continue
            covered = found_by_automaton([whole[a: a + n] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)], phrases)
            on = [i for i, (a, _) in enumerate(covered) if len(a)]
            runs = [[{"first": x, "count": y} for x, y in zip(*(v.tolist() for v in covered[i]), strict=True)] for i in on]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(d0[one[on]]), pa.array(d1[one[on]]), pa.array(runs, kind)], ["d0", "d1", "runs"])

    return run


def repeated_words(base: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, text_hash and runs (first, count) of the words that repeated windows cover. ``base`` has text as bytes."""
    anchors = base.select("text").mapInArrow(_anchors(window, gram), "anchor long, d0 long, multi boolean")
    anchors = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("d0") != F.max("d0")).alias("differ"), F.max("multi").alias("multi"))
    anchors = cut(anchors.filter("n > 1 OR multi"))
    hot = anchors.filter((F.col("n") > hot_stretches) & F.col("differ")).select("anchor")
    # whatever else the bitmap of hot anchors lets through is taken apart everywhere, and nothing is lost by that
    hot = bitmap_of(hot, "anchor", bits_for(hot.count()) or MOST_BITS)
    noted = cut(base.mapInArrow(_noted(bitmap_of(anchors, "anchor", bits_for(anchors.count())), hot, window, gram), PLACES))
    key = ["d0", "d1"]
    counts = noted.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"), F.min(F.struct("text_hash", "doc_id", "first", "count", "anchor")).alias("place"))
    counts = cut(counts.select(*key, "n", "multi", "place.*"))
    # a stretch whose anchor is nowhere else has nothing to be compared with; the bitmap let it through
    alone = counts.groupBy("anchor").agg(F.sum("n").alias("all"), F.max("multi").alias("some")).filter("all > 1 OR some").select("anchor")
    chosen = cut(counts.join(alone, "anchor", "left_semi").drop("multi"))
    total = chosen.agg(F.coalesce(F.sum(F.col("count") + window - 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // shard_words)))).alias("shard")
    places = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "count", shard, *key, "n")).alias("chosen"))
    _, texts = with_rows(base, cut(places))
    bodies = texts.filter("chosen IS NOT NULL").mapInArrow(_words_at(window), "shard long, d0 long, d1 long, n long, body binary")
    dealt = bodies.repartition(width(base), "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_shards(window), "d0 long, d1 long, runs array<struct<first: long, count: long>>")
    found = cut(found.join(chosen.select(*key, "n"), key))
    everywhere = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = joined(noted.select("doc_id", "text_hash", "first", *key), found, key, "n", everywhere)
    places = places.select("doc_id", "text_hash", F.transform("runs", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), r["count"].alias("count"))).alias("runs"))
    # a set: rows that repeat id and text have the same runs
    return places.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and a digest of those that stay."""
    for batch in pieces_of(batches, "text", BATCH_BYTES):
        words = Text(_bytes(batch))
        gone = np.zeros(len(words.starts) + 1, np.int32)
        if "runs" in batch.schema.names:
            runs = batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            first, count = (x.to_numpy() for x in runs.flatten().flatten())
            np.add.at(gone, words.begins[of] + first, 1)
            np.add.at(gone, words.begins[of] + first + count, -1)
        gone = np.cumsum(gone)[:-1] > 0
        left = np.cumsum(np.concatenate([[0], np.where(gone, 0, words.ends - words.starts + 1)]))
        kept = words.bytes[~np.repeat(gone, words.ends - words.starts + 1)].tobytes()
        total = np.cumsum(np.concatenate([[0], gone]))
        ends = words.begins + words.counts
        shown = [hashlib.sha256(kept[a: max(a, b - 1)]).hexdigest() for a, b in zip(left[words.begins].tolist(), left[ends].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(total[ends] - total[words.begins]), pa.array(shown, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_phrases(df: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    base = documents(df).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    runs = cut(repeated_words(base, window, gram, shard_words, hot_stretches))
    free, touched = with_rows(base, runs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    touched = touched.select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<first: long, count: long>>")).alias("runs"))
    return free.select("doc_id", "text").mapInArrow(_kept, schema).unionByName(touched.mapInArrow(_kept, schema))
