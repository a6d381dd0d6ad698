"""Packing tokenized documents into sequences by linear grouping, then best fit.

Whether pieces fit depends on their lengths alone, and there are at most ``capacity`` lengths, so the plan is
made from the histogram of lengths: it has one count a length, whatever the corpus. Large lengths are rounded up
to the greatest of groups with equally many pieces; configurations of these few sizes are chosen by a knapsack
and repeated as often as pieces last; the pieces' own lengths then replace the rounded ones and small pieces
go where they leave least space. The plan is a list of runs: pieces number a to b of one length go, one each,
to sequences s, s+1, ... at one offset. Pieces are numbered in parallel (by partition and length) and find
their run by binary search.

Defined cases: null text counts as empty and gives the end id alone; only documents over the capacity are cut;
repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merges import Merges
from .shared import cut, documents, pieces_of
from .token_counts import byte_letters, normal
from .words import distinct, split

CAPACITY = 2048
#: Lengths over a share of the capacity are grouped, the others are small: plans are made for these shares until one can't be bettered.
LARGE = (1 / 3, 1 / 2, 1 / 8)
GROUPS = 64
BATCH_BYTES = 6_000_000
END_ID = 0
RUN = np.dtype([("length", np.int64), ("first", np.int64), ("count", np.int64), ("sequence", np.int64), ("offset", np.int64)])


@functools.cache
def codec(path: str) -> tuple[Merges, np.ndarray, np.ndarray]:
    """The merges of a vocabulary with word ends, the id of each byte, and of each byte at a word's end."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = Merges((ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs))
    inner, final = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for letter, byte in byte_letters().items():
        inner[byte], final[byte] = ids[letter], ids[letter + "</w>"]
    return merges, inner, final


@functools.cache
def added_tokens(path: str) -> tuple[re.Pattern, dict[str, bytes]]:
    """Where the vocabulary's added tokens stand in a raw text, the longest first, and the id of each."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(x.get(flag) for x in found for flag in ("normalized", "single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens are found in raw texts only, without a look at what stands beside them")
    names = sorted((x["content"] for x in found), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, names)) or '(?!)'})"), {x["content"]: x["id"].to_bytes(4, "little") for x in found}


def encode_batch(path: str, texts: list[str], special: bool = False) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers; strings of added tokens are ordinary text unless ``special``."""
    if not special:
        yield from _encoded(path, texts)
        return
    pattern, ids = added_tokens(path)
    parts = [pattern.split(t) for t in texts]  # every second part is an added token
    plain = _encoded(path, [t for own in parts for t in own[::2]])
    for own in parts:
        yield b"".join(ids[t] if i % 2 else next(plain) for i, t in enumerate(own))


def _encoded(path: str, texts: list[str]) -> Iterator[bytes]:
    merges, inner, final = codec(path)
    words = split(list(map(normal, texts)), keep_spaces=False)
    codes, model = distinct(words)
    ids: list = [b""] * len(model)
    for rows, out in merges.encoded(words.data, words.starts[model], words.sizes[model], inner, final):
        data, size = out.astype("<u4").tobytes(), 4 * out.shape[1]
        for i, w in enumerate(rows.tolist()):
            ids[w] = data[i * size: (i + 1) * size]
    at, ends = codes.tolist(), np.cumsum(words.counts).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield b"".join(map(ids.__getitem__, at[a:b]))


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_batch(path, batch.column("text").to_pylist(), special), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences by the space left in them, as ranges; every placing of pieces is a run."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.next, self.sequences = capacity, dict(counts), defaultdict(int), 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, ranges: list[tuple[int, int]], room: int) -> None:
        """A piece of this length into each sequence of the ranges, which have so much room."""
        for s, n in ranges:
            self.runs.append((length, self.next[length], n, s, self.capacity - room))
            self.next[length] += n
            self.left[length] -= n
            if room > length:
                self.room[room - length].append((s, n))

    def open(self, n: int) -> list[tuple[int, int]]:
        self.sequences += n
        return [(self.sequences - n, n)]

    def take(self, room: int, n: int) -> list[tuple[int, int]]:
        """Ranges of n sequences, or all, of those with so much room."""
        out, own = [], self.room[room]
        while own and n:
            s, k = own.pop()
            out.append((s, min(k, n)))
            if k > n:
                own.append((s + n, k - n))
            n -= out[-1][1]
        return out

    def large(self, least: int, groups: int) -> None:
        """Linear grouping of the lengths over ``least``."""
        lengths = sorted((x for x, n in self.left.items() if x > least and n), reverse=True)
        total, seen, members = sum(self.left[x] for x in lengths), 0, defaultdict(list)
        for x in lengths:  # a length is not split: its group is where its first piece is
            members[seen * groups // max(total, 1)].append(x)
            seen += self.left[x]
        sizes = [(max(own), own) for own in members.values()]
        while any(self.left[x] for _, own in sizes for x in own):
            stock = [(size, sum(self.left[x] for x in own), own) for size, own in sizes]
            chosen = self.configuration([(size, n) for size, n, _ in stock])
            times = min(n // chosen[size] for size, n, _ in stock if chosen.get(size))
            # the pieces' own lengths take the places of the rounded ones
            slots = [own for size, _, own in sorted(stock, reverse=True) for _ in range(chosen.get(size, 0))]
            groups_of = [(self.open(times), self.capacity)]
            for k, own in enumerate(slots):
                # the last one is whatever fills best, as the others are shorter than their sizes
                groups_of = [y for ranges, room in groups_of for y in self.fill(ranges, room, own if k + 1 < len(slots) or not k else range(room, 0, -1))]
            for ranges, room in groups_of:
                self.room[room] += ranges if room else []

    def fill(self, ranges: list[tuple[int, int]], room: int, own: Iterable[int]) -> list[tuple[list[tuple[int, int]], int]]:
        """One piece of a group into each sequence, greatest lengths first; the ranges by what room is left."""
        out = []
        for s, n in ranges:
            for x in own:
                k = min(n, self.left.get(x, 0))
                if k:
                    self.runs.append((x, self.next[x], k, s, self.capacity - room))
                    self.next[x] += k
                    self.left[x] -= k
                    out.append(([(s, k)], room - x))
                    s, n = s + k, n - k
                if not n:
                    break
            else:
                out.append(([(s, n)], room))
        return out

    def configuration(self, stock: list[tuple[int, int]]) -> dict[int, int]:
        """How many pieces of each size fill a sequence best, of those in stock; it holds the greatest size in stock."""
        stock = sorted(((size, n) for size, n in stock if n), reverse=True)
        first = stock[0][0]
        best: list[dict[int, int] | None] = [None] * (self.capacity - first + 1)
        best[0] = {first: 1}
        for size, n in stock:
            for total in range(len(best) - 1, -1, -1):
                if best[total] is None:
                    continue
                have = best[total]
                for k in range(1, min(n - have.get(size, 0), (len(best) - 1 - total) // size) + 1):
                    if best[total + k * size] is None:
                        best[total + k * size] = have | {size: have.get(size, 0) + k}
        return next(x for x in reversed(best) if x is not None)

    def small(self) -> None:
        """Best fit, greatest lengths first; new sequences where nothing has room."""
        for x in sorted((x for x, n in self.left.items() if n), reverse=True):
            # what is left beside a piece may take another of its length: the least room is looked for again
            while self.left[x] and (room := next((r for r in range(x, self.capacity + 1) if self.room.get(r)), None)):
                self.put(x, self.take(room, self.left[x]), room)
            while n := self.left[x]:
                each = self.capacity // x
                ranges, room = self.open(-(-n // each)), self.capacity
                while self.left[x] and room >= x:
                    now = min(self.left[x], sum(k for _, k in ranges))
                    s = ranges[0][0]
                    if now < ranges[0][1]:
                        self.room[room].append((s + now, ranges[0][1] - now))
                    self.runs.append((x, self.next[x], now, s, self.capacity - room))
                    self.next[x] += now
                    self.left[x] -= now
                    ranges, room = [(s, now)], room - x
                if room:
                    self.room[room] += ranges


def plan(counts: dict[int, int], capacity: int = CAPACITY, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> np.ndarray:
    """The runs that place so many pieces of each length, by length and first piece: of the plans tried, the one with the fewest sequences."""
    least, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for share in large:
        p = Plan(counts, capacity)
        p.large(int(capacity * share), groups)
        p.small()
        best = p if best is None or p.sequences < best.sequences else best
        if best.sequences == least:
            break
    return np.sort(np.array(best.runs, RUN), order=["length", "first"])


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; ``special`` as in ``encode_batch``."""
    found = cut(pieces(df, path, capacity, special).withColumn("part", F.spark_partition_id()))
    counts = cut(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # at most one row for each length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # the number of a piece among those of its partition and length, then among all of its length
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = found.join(counts, ["part", "length"]).withColumn("number", F.col("before") + F.row_number().over(inside) - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*columns, "number").mapInArrow(_placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placed(runs: np.ndarray):
    key = runs["length"] << 40 | runs["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length << 40 | number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs["sequence"][at] + number - runs["first"][at]), pa.array(runs["offset"][at])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run
