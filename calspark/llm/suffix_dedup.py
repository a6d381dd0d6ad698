"""Removing repeated passages by suffix arrays.

Every byte that lies in a string of MATCH bytes which starts at another place too is removed. The work goes in
four steps, each a pass or a shuffle:

1. Anchors. The least hash of GRAM bytes within each string of MATCH bytes is its anchor: equal strings have equal
   anchors. Starts in a row with the same anchor make a piece, the bytes of all strings that start there. Anchors
   that occur once can't take part in a repetition; a bitmap of the others, sized by their number and of 64 MB at most, spares most
   pieces the next shuffle (beyond 134 million anchors all go there, as places of some 60 bytes).
2. Places of the pieces with a noted anchor. Equal pieces (by a cryptographic digest of 128 bits) are one piece with a count, and
   repeated throughout; the bytes of one that has others of its anchor to be compared with are read at one place.
3. Shards by anchor. Each has the suffix array of its pieces (Larsson-Sadakane refinement: groups of equal prefixes are
   sorted by the rank of what follows, which doubles the prefix each time), and its common prefixes (Kasai, for all pieces in
   step). Neighbours with MATCH bytes in common are repeated. An anchor with more pieces
   than a shard holds is dealt to several; these hand over the strings that are new to them in order, by ranges (as
   cryptographic digests, so that no bytes are sent twice), and these are merged by binary search.
4. What is found in a piece holds at all its places. These are joined with the texts of their documents, and the bytes they cover are cut out.

Defined cases: null text counts as empty; texts shorter than MATCH lose nothing; matches never cross documents but may
overlap and may be within one; repeated rows are places of their own; documents of any length are read whole; a null
doc_id is an id like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_of, bits_for, cut, documents, grouped, in_bitmap, joined, pieces_of, ragged, value_sizes, width, with_rows

MATCH, GRAM = 400, 128
WINDOW = MATCH - GRAM + 1
#: Starts of a piece, at most.
PIECE_STARTS = 512
#: Bytes of a shard, about, and of an array at most, but for one anchor's share; an array takes some 110 times as much while it is made.
SHARD_BYTES = 1_000_000
BATCH_BYTES = 2_000_000
DIGESTS = 65_536
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.ndarray((len(data),), "<u8", padded, strides=(1,)))


def doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings twice as long, from those of strings of ``step`` bytes."""
    out = h * M1
    out ^= out >> np.uint64(32)
    out[: max(len(h) - step, 0)] += h[step:] * M2
    out ^= out >> np.uint64(29)
    return out


def least(h: np.ndarray, window: int, ufunc=np.minimum) -> np.ndarray:
    """The least of each value and the window - 1 behind it (fewer at the end)."""
    fill = np.iinfo(np.uint64).max if ufunc is np.minimum else 0
    size = -(-len(h) // window) * window + window
    padded = np.full(size, fill, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, window)
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    forth = ufunc.accumulate(blocks, axis=1).ravel()
    return ufunc(back[: len(h)], forth[window - 1: window - 1 + len(h)])


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic digest of each stretch of the data: equal ones have equal bytes."""
    out = np.empty((len(starts), 2), np.int64)
    for i in range(0, len(starts), DIGESTS):
        some = slice(i, i + DIGESTS)
        found = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        out[some] = np.frombuffer(found, np.int64).reshape(-1, 2)
    return out


def anchored(h: np.ndarray, begins: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of starts (so many in each text, from its first place on) with the same anchor, the least of ``window`` hashes from there.

    Returned are text, first place, number of starts, anchor, and whether a run may hold a string twice.
    """
    minima = least(h, window)
    at = ragged(begins, starts)
    text = np.repeat(np.arange(len(begins)), starts)
    value = minima[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    length_of = np.diff(np.append(run, len(at)))
    parts = -(-length_of // PIECE_STARTS)
    cuts = ragged(np.zeros(len(run), np.int64), parts) * PIECE_STARTS
    owner = np.repeat(np.arange(len(run)), parts)
    first = at[run[owner]] + cuts
    count = np.minimum(length_of[owner] - cuts, PIECE_STARTS)
    anchor = value[run[owner]].view(np.int64)
    # places that are the least of some window; a piece with two of its own value may repeat in itself
    chosen = np.flatnonzero(least(minima[::-1], window, np.maximum)[::-1] == h)
    lo, hi = np.searchsorted(chosen, first), np.searchsorted(chosen, first + count + window - 1)
    inside = ragged(lo, hi - lo)
    own = np.repeat(np.arange(len(lo)), hi - lo)
    multi = (np.bincount(own, h[chosen[inside]].view(np.int64) == anchor[own], len(lo)) > 1) | (parts[owner] > 1)
    return text[run[owner]], first, count, anchor, multi


class Pieces:
    """The pieces of a batch of texts: text, first start, number of starts, anchor, digest, whether it may repeat in itself."""

    def __init__(self, texts: list[bytes], match: int = MATCH, gram: int = GRAM):
        window = match - gram + 1
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(sizes) - sizes
        starts = np.maximum(sizes - match + 1, 0)
        empty = np.zeros(0, np.int64)
        self.text = self.first = self.count = self.at = self.size = empty
        self.anchor, self.multi, self.digest = empty, np.zeros(0, bool), np.zeros((0, 2), np.int64)
        if not starts.any():
            return
        h, length = eights(self.data), 8
        while length * 2 <= gram:
            h = doubled(h, length)
            length *= 2
        if length < gram:
            raise ValueError("gram has to be a power of two from 8 on")
        self.text, self.at, self.count, self.anchor, self.multi = anchored(h, self.begins, starts, window)
        self.first = self.at - self.begins[self.text]
        self.size = self.count + match - 1
        self.digest = digests(self.data.tobytes(), self.at, self.at + self.size)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [bytes(x.as_buffer()) for x in batch.column("text")]


def _anchors(match: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            p = Pieces(_bytes(batch), match, gram)
            yield pa.RecordBatch.from_arrays([pa.array(p.anchor), pa.array(p.multi)], ["anchor", "multi"])

    return run


PLACES = "doc_id long, text_hash long, first long, count long, anchor long, d0 long, d1 long, multi boolean"


def _noted(repeated: np.ndarray | None, match: int, gram: int):
    """The places of the pieces whose anchor is in the bitmap, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            p = Pieces(_bytes(batch), match, gram)
            on = np.flatnonzero(in_bitmap(repeated, p.anchor))
            rows = pa.array(p.text[on])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(p.first[on]), pa.array(p.count[on]), pa.array(p.anchor[on]), pa.array(p.digest[on, 0]), pa.array(p.digest[on, 1]), pa.array(p.multi[on])],
                [c.split()[0] for c in PLACES.split(", ")],
            )

    return run


BODIES = "shard long, part int, parts int, anchor long, d0 long, d1 long, n long, count long, body binary"


def _bodies(match: int):
    """The bytes of the pieces that were chosen in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            chosen, texts = batch.column("chosen"), _bytes(batch)
            of = np.repeat(np.arange(batch.num_rows), np.diff(chosen.offsets.to_numpy())).tolist()
            own = dict(zip(("first", "shard", "part", "parts", "anchor", "d0", "d1", "n", "count"), chosen.flatten().flatten(), strict=True))
            body = [texts[i][a: a + c + match - 1] for i, a, c in zip(of, own["first"].to_pylist(), own["count"].to_pylist(), strict=True)]
            names = [c.split()[0] for c in BODIES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(own[c] for c in names[:-1]), pa.array(body, pa.binary())], names)

    return run


def suffix_array(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes of all pieces (each ends with its piece), in order."""
    n = len(data)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(begins + sizes, sizes) - np.arange(n)
    head = np.minimum(left, 8).astype(np.uint8)
    key = eights(data).byteswap()
    short = left < 8  # the piece ends within: nothing equals it
    ending = np.flatnonzero(short)
    key[ending] &= ~np.uint64(0) << (np.uint64(64) - head[ending].astype(np.uint64) * np.uint64(8))
    tie = np.where(short, piece + 1, 0).astype(np.int32)
    order = np.lexsort((tie, head, key))
    key, tie = key[order], tie[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1]) | short[order][1:]
    del key, tie, head, short, ending
    group = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    del group
    h = 8
    while True:
        bounds = np.flatnonzero(np.append(new, True))
        large = np.flatnonzero(np.diff(bounds) > 1)
        if not len(large):
            return order
        places = ragged(bounds[large], np.diff(bounds)[large])
        own = order[places]
        follow = np.where(left[own] > h, rank[np.minimum(own + h, n)], piece[own] - len(sizes))  # a piece ends with a letter of its own, before all others
        by = np.lexsort((follow, rank[own]))
        own, follow = own[by], follow[by]
        order[places] = own
        split = np.ones(len(own), bool)
        split[1:] = (rank[own][1:] != rank[own][:-1]) | (follow[1:] != follow[:-1])
        new[places] = split
        starts = np.flatnonzero(split)
        fresh = np.repeat(places[starts], np.diff(np.append(starts, len(own))))
        rank[own] = fresh
        h *= 2


def common_prefixes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix what it has in common with the one before it in order, up to ``limit`` (Kasai, all pieces in step)."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    ends = np.repeat(begins + sizes, sizes)
    out = np.zeros(n, np.int64)
    words = eights(data)
    at, stop, h = begins.copy(), begins + sizes, np.zeros(len(sizes), np.int64)
    while len(at):
        other = before[at]
        there = other >= 0
        room = np.minimum(ends[at] - at, np.where(there, ends[np.maximum(other, 0)] - other, 0))
        room = np.minimum(room, limit)
        a, b = np.minimum(at + h, n - 1), np.minimum(np.maximum(other, 0) + h, n - 1)
        differ = words[a] ^ words[b]
        # equal bytes from here on, eight at a time: the lowest bit that differs tells how many
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        grown = np.minimum(h + equal, room)
        more = there & (equal == 8) & (grown < room)
        h = np.maximum(grown, np.minimum(h, room))
        done = ~more
        out[at[done]] = h[done]
        # where the limit was met, what follows has limit - 1 bytes in common at least, as after any other
        at = at + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        on = at < stop
        if not on.all():
            at, stop, h = at[on], stop[on], h[on]
    return out


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each stretch of consecutive places (sorted)."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1] + 1
    first = np.flatnonzero(new)
    return places[first], np.diff(np.append(first, len(places)))


SHARD_SCHEMA = "d0 long, d1 long, first long, count long, anchor long, part int, g0 array<long>, g1 array<long>, p0 array<long>, p1 array<long>, starts array<long>"


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    arrays = []
    for field in SHARD_SCHEMA.split(", "):
        name, kind = field.split(" ")
        arrow = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[kind]
        if kind == "array<long>" and name in columns:  # one array, of the only row
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(columns[name])], pa.int32()), pa.array(columns[name], pa.int64())))
            continue
        arrays.append(pa.array(columns[name], arrow) if name in columns else pa.nulls(n, arrow))
    return pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in SHARD_SCHEMA.split(", ")])


def _stretches(shard: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """A shard, sorted by anchor, in stretches of whole anchors, of ``limit`` bytes or one anchor at most: equal strings have equal anchors."""
    anchor = shard.column("anchor").to_numpy()
    bounds = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
    ends = np.cumsum(value_sizes(shard.column("body")))[bounds[1:] - 1]
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield shard.slice(bounds[at], bounds[stop] - bounds[at])
        at = stop


def _shards(match: int, limit: int):
    """Runs of repeated starts of each piece in a shard; of an anchor in several parts also the digests of its strings, by range.

    Nothing is told of a piece that is at several places: all of it is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (x for whole in grouped(batches, ["shard", "part"]) for x in _stretches(whole, limit)):
            _, one = np.unique(np.rec.fromarrays([shard.column("d0").to_numpy(), shard.column("d1").to_numpy()]), return_index=True)  # rows that are there twice
            shard = shard.take(pa.array(one))
            d0, d1, count, copies = (shard.column(c).to_numpy() for c in ("d0", "d1", "count", "n"))
            bodies = [bytes(x.as_buffer()) for x in shard.column("body")]
            data = np.frombuffer(b"".join(bodies), np.uint8)
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            begins = np.cumsum(sizes) - sizes
            order = suffix_array(data, begins, sizes)
            prefix = common_prefixes(data, begins, sizes, order, match)
            by_rank = prefix[order] >= match
            again = by_rank.copy()
            again[:-1] |= by_rank[1:]
            found = np.zeros(len(data), bool)
            found[order] = again
            # runs end with their piece: its last strings reach the end, and suffixes that are shorter are never found
            piece = np.repeat(np.arange(len(sizes)), sizes)
            single = copies == 1
            starts, counts = runs_of(np.flatnonzero(found & single[piece]))
            at = piece[starts] if len(starts) else starts
            if len(starts):
                yield _rows({"d0": d0[at], "d1": d1[at], "first": starts - begins[at], "count": counts}, len(at))
            parts = shard.column("parts")[0].as_py()
            if parts > 1:
                valid = ragged(begins, count)
                digest = digests(data.tobytes(), valid, valid + match)
                # strings found here stand for themselves once, without asking back
                ranges = (digest[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
                place = np.where(~found[valid] & single[piece[valid]], valid - begins[piece[valid]], -1)
                by = np.lexsort((digest[:, 1], digest[:, 0], ranges))
                digest, ranges, place, owner = digest[by], ranges[by], place[by], piece[valid][by]
                keep = np.ones(len(by), bool)
                keep[1:] = (digest[1:] != digest[:-1]).any(1)
                digest, ranges, place, owner = digest[keep], ranges[keep], place[keep], owner[keep]
                for r in np.unique(ranges):
                    a = np.flatnonzero(ranges == r)
                    yield _rows({"anchor": [shard.column("anchor")[0].as_py()], "part": [int(r)], "g0": digest[a, 0], "g1": digest[a, 1], "p0": d0[owner[a]], "p1": d1[owner[a]], "starts": place[a]}, 1)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of strings that another shard has too: each shard's sorted digests are looked up in all others'."""
    for group in grouped(batches, ["anchor", "part"]):
        shards = [{c: group.column(c)[i].values.to_numpy() for c in ("g0", "g1", "p0", "p1", "starts")} for i in range(group.num_rows)]
        # a shard's digests are distinct and sorted: a digest is shared if two places of the whole list hold it
        keys = [np.rec.fromarrays([s["g0"], s["g1"]]) for s in shards]
        every = np.sort(np.concatenate(keys), order=["f0", "f1"])
        rank0 = every["f0"]
        for s in shards:
            low, high = np.searchsorted(rank0, s["g0"], "left"), np.searchsorted(rank0, s["g0"], "right")
            shared = high - low > 1
            for i in np.flatnonzero(shared):  # equal first hashes: the second decides
                shared[i] = np.count_nonzero(every["f1"][low[i]: high[i]] == s["g1"][i]) > 1
            on = np.flatnonzero(shared & (s["starts"] >= 0))
            if len(on):
                yield _rows({"d0": s["p0"][on], "d1": s["p1"][on], "first": s["starts"][on], "count": np.ones(len(on), np.int64)}, len(on))


def repeated_starts(df: DataFrame, match: int = MATCH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_hash and runs (first, count) of starts of strings that are at another place too. ``df`` has text as bytes."""
    anchors = df.select("text").mapInArrow(_anchors(match, gram), "anchor long, multi boolean")
    anchors = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi")).filter("n > 1 OR multi")
    anchors = cut(anchors.select("anchor"))
    noted = cut(df.mapInArrow(_noted(bitmap_of(anchors, "anchor", bits_for(anchors.count())), match, gram), PLACES))
    key = ["d0", "d1"]
    counts = noted.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"), F.min(F.struct("text_hash", "doc_id", "first", "count", "anchor")).alias("place"))
    counts = cut(counts.select(*key, "n", "multi", "place.*"))
    # an anchor with one piece that can't repeat in itself has nothing to compare; it got here by the bitmap or as equal pieces
    sizes = counts.groupBy("anchor").agg(F.sum(F.col("count") + match - 1).alias("bytes"), F.max("multi").alias("some"), F.count(F.lit(1)).alias("k")).filter("k > 1 OR some")
    sizes = cut(sizes.select("anchor", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"), "bytes", "k"))
    total, k = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    pieces = joined(counts.drop("multi"), sizes.drop("bytes"), ["anchor"], "k", k)
    part = F.pmod(F.xxhash64(*key), F.col("parts")).cast("int").alias("part")
    # anchors in one part share shards; others have shards of their own
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor").bitwiseOR(F.lit(-(2**63)))).alias("shard")
    places = pieces.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", shard, part, "parts", "anchor", *key, "n", "count")).alias("chosen"))
    _, texts = with_rows(df, cut(places))
    bodies = texts.filter("chosen IS NOT NULL").mapInArrow(_bodies(match), BODIES)
    dealt = bodies.repartition(width(df), "shard", "part").sortWithinPartitions("shard", "part", "anchor")
    found = cut(dealt.mapInArrow(_shards(match, shard_bytes), SHARD_SCHEMA))
    merged = found.filter("part IS NOT NULL").repartition(width(df), "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_merged, SHARD_SCHEMA)
    found = found.filter("part IS NULL").select(*key, "first", "count").unionByName(merged.select(*key, "first", "count"))
    found = found.groupBy(*key).agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), "count")).alias("runs")
    found = found.unionByName(counts.filter("n > 1").select(*key, whole))  # equal pieces
    found = cut(found.join(counts.select(*key, "n"), key))
    everywhere = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = joined(noted.select("doc_id", "text_hash", "first", *key), found, key, "n", everywhere)
    return places.select("doc_id", "text_hash", F.transform("runs", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), r["count"].alias("count"))).alias("runs"))


def _removed(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            rows = []
            for text, runs in zip(_bytes(batch), batch.column("runs"), strict=True):
                gone = np.zeros(len(text) + 1, np.int32)
                if runs.is_valid and len(runs.values):
                    first, count = (runs.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + count + match - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(df: DataFrame, match: int = MATCH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    base = documents(df).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    runs = repeated_starts(base, match, gram, shard_bytes)
    # a set: rows that repeat id and text have the same runs
    runs = cut(runs.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs")))
    free, texts = with_rows(base, runs)
    free = free.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    cleaned = texts.select("doc_id", "text", "runs")
    return free.unionByName(cleaned.mapInArrow(_removed(match), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
