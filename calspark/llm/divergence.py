"""How the sources of a language differ in their words, by count-level bitmaps.

Each group (language and source) and each language gives every term of the language's vocabulary a share of 10^9,
with two added to each count. A pair of sources differs by the sum of f = floor((p - q)^2 / (p + q)) over the vocabulary.
As f depends only on the two counts, terms are counted by cells, not one by one: a group's terms that occur
there exactly c times are a bitset over the numbers of terms (a level), and the terms that occur c times in one group and d times in another
are the bits that two levels have in common. Cells with a zero on one side are what the levels leave over.

The vocabulary is dealt to blocks of about BLOCK_TERMS terms of similar frequency (so that a block has few levels), numbered within their
block. A task compares the levels of one block and of two bounded sets of groups at most (a tile), and returns a number for each pair
that meets there, already multiplied by f; whatever has a zero follows from the sizes of levels alone, once for each pair.

Terms are counted within each Arrow batch, then by Spark with partial sums, so a source with a third of all rows is no burden; nothing
but literals goes through the driver. All arithmetic is on whole numbers: shares by decimals or by long division, both exact.

Defined cases: null text, lang and source count as empty ones; repeated rows count as often as they occur; a group without terms, or a language
without vocabulary, still has its pairs (value 0 if the vocabulary is empty); a language with one source has no pairs; doc_id is not read;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, grouped, joined, pieces_of, width

#: A term of the vocabulary is in so many documents of the language at least.
LEAST_DOCUMENTS = 10
ADDED, WHOLE = 2, 1_000_000_000
#: Terms that the report on one group names.
TOP = 10
BLOCK_TERMS = 4096
#: Bytes of a level: twice the terms that a block has on average.
LEVEL_BYTES = BLOCK_TERMS // 4
#: Groups of a set; two sets are a tile.
SET_GROUPS = 32
BATCH_BYTES = 4_000_000
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 400_000
#: Words of bitsets that are combined at a time.
WORDS_AT_ONCE = 1 << 21

#: Letters of ASCII in lower case and all bytes beyond ASCII are parts of terms; what is left separates them.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, handed on whenever there are HELD_TERMS of them."""
    count, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    for batch in pieces_of(batches, "text", BATCH_BYTES):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            terms = bytes(text.as_buffer()).translate(TERM_BYTES).split()
            own = count[lang, source]
            held -= len(own)
            own.update(terms)
            docs[lang, source].update(set(terms))
            held += len(own)
        if held > HELD_TERMS:
            yield from _held(count, docs)
            count, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from _held(count, docs)


def _held(count: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in count.items():
        n = len(own)
        columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([docs[lang, source][t] for t in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / whole), three digits at a time, so that nothing exceeds 64 bits."""
    rest, out = counts.astype(np.int64) + ADDED, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _share(count: str, whole: str) -> Column:
    return (F.expr(f"(CAST({count} + {ADDED} AS DECIMAL(20, 0)) * CAST({WHOLE} AS DECIMAL(10, 0))) div CAST({whole} AS DECIMAL(20, 0))") + 1).cast("long")


TILE = ["lang", "band", "bucket", "lo", "hi"]
PAIR_SCHEMA = "lang string, one string, two string, value long"


def _pairs(lang: str, one: list, two: list, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(value, pa.int64())], ["lang", "one", "two", "value"])


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two groups both have change against cells with a zero, for each pair of groups of a tile."""
    for tile in grouped(batches, TILE):
        own = tile.column("set").to_numpy()
        lang, lo, hi = (tile.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
        source = tile.column("source").to_pylist()
        starts = [0, *(i for i in range(1, len(source)) if source[i] != source[i - 1])]
        ends = [*starts[1:], len(source)]
        bits = np.frombuffer(b"".join(x.as_py() for x in tile.column("bits")), "<u8").reshape(len(source), -1)
        used = np.flatnonzero(np.bitwise_or.reduce(bits, axis=0))
        bits = np.ascontiguousarray(bits[:, : used[-1] + 1])
        count, whole = tile.column("count").to_numpy(), tile.column("whole").to_numpy()
        p, zero = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
        for a, b in zip(starts, ends, strict=True):
            p[a:b], zero[a:b] = shares(count[a:b], int(whole[a])), shares(np.zeros(1), int(whole[a]))[0]
        one, two, value = [], [], []
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            # the groups behind it, of the other set if the tile has two
            later = [j for j in range(len(starts)) if (j > k if lo == hi else own[starts[j]] == hi and own[a] == lo)]
            if not later:
                continue
            rows = np.concatenate([np.arange(starts[j], ends[j]) for j in later])
            cuts = np.cumsum([0, *(ends[j] - starts[j] for j in later[:-1])])
            total = np.zeros(len(rows), np.int64)
            step = max(1, WORDS_AT_ONCE // (len(rows) * bits.shape[1]))
            for at in range(a, b, step):
                mine = slice(at, min(at + step, b))
                cells = np.bitwise_count(bits[mine, None, :] & bits[None, rows, :]).sum(2, dtype=np.int64)
                left, right = p[mine, None], p[None, rows]
                change = differ(left, right) - differ(left, zero[None, rows]) - differ(zero[mine, None], right) + differ(zero[mine, None], zero[None, rows])
                total += (cells * change).sum(0)
            one += [source[a]] * len(later)
            two += [source[starts[j]] for j in later]
            value += np.add.reduceat(total, cuts).tolist()
        yield _pairs(lang, one, two, value)


def _with_zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of groups of a tile, as if no term occurred in both."""
    for tile in grouped(batches, ["lang", "lo", "hi"]):
        lang, lo, hi = (tile.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
        source, own, terms = tile.column("source").to_pylist(), tile.column("set").to_pylist(), tile.column("terms")[0].as_py()
        levels = []
        for whole, counts, sizes in zip(tile.column("whole").to_pylist(), tile.column("counts"), tile.column("sizes"), strict=True):
            size = np.array(sizes.as_py() or [], np.int64)
            p = shares(np.array([0, *(counts.as_py() or [])], np.int64), whole) if terms else np.ones(1, np.int64)
            levels.append((p[1:], p[:1], size))
        one, two, value = [], [], []
        for i, (p, p0, m) in enumerate(levels):
            for j, (q, q0, n) in enumerate(levels):
                if not (j > i if lo == hi else own[i] == lo and own[j] == hi):
                    continue
                alone = int((m * differ(p, q0)).sum()) + int((n * differ(p0, q)).sum())
                one.append(source[i])
                two.append(source[j])
                value.append(alone + (terms - int(m.sum()) - int(n.sum())) * int(differ(p0, q0)[0]) if terms else 0)
        if one:
            yield _pairs(lang, one, two, value)


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row once for each tile of its set."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    return rows.withColumn("lo", F.least("set", "other")).withColumn("hi", F.greatest("set", "other"))


def divergence(df: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS, set_groups: int = SET_GROUPS) -> DataFrame:
    """lang, source, part, item, value and rank: for each group how far each other source is, and its own terms."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = df.select(*named)
    cells = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    cells = cut(cells.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    kept = cells.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents)
    kept = cut(kept.select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("band")))
    bands = cut(kept.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n"))).withColumn("buckets", F.ceil(F.col("n") / block_terms).cast("int"))
    placed = joined(kept, bands, ["lang", "band"], "n", kept.count()).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    # the numbers of terms within their block, which holds a bounded number of them; blocks are dealt one by one, not by band
    placed = placed.drop("n").repartition(width(df), "lang", "band", "bucket").withColumn("number", F.row_number().over(Window.partitionBy("lang", "band", "bucket").orderBy("term")))
    found = cut(cells.drop("docs").join(placed.drop("buckets"), ["lang", "term"]))
    langs = docs.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n")), "lang", "left")
    langs = langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("n", F.lit(0)).alias("n_lang"))
    groups = docs.select("lang", "source").distinct().join(found.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang")
    sets = docs.select("lang", "source").distinct().groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / set_groups).cast("int").alias("sets"))
    groups = groups.join(sets, "lang").withColumn("set", F.pmod(F.xxhash64("source"), F.col("sets")).cast("int"))
    groups = cut(groups.select("lang", "source", "terms", "sets", "set", (F.coalesce("n", F.lit(0)) + 2 * F.col("terms")).alias("whole"), (F.col("n_lang") + 2 * F.col("terms")).alias("whole_lang")))
    pairs = _pair_values(found, groups).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    pairs = cut(pairs)
    both = pairs.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(pairs.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value"))
    own = found.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("count", "whole").alias("p"), _share("total", "whole_lang").alias("q")).filter("p > q")
    own = own.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    both = both.withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    own = own.withColumn("rank", ranked).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return both.select(*columns).unionByName(own.select(*columns))


def levels_of(found: DataFrame) -> DataFrame:
    """lang, source, band, bucket, count and bits: the terms of a block that a group has exactly so often."""
    at = F.bitmap_bit_position("number")
    return found.groupBy("lang", "source", "band", "bucket", "count").agg(F.substring(F.bitmap_construct_agg(at), 1, LEVEL_BYTES).alias("bits"))


def _pair_values(found: DataFrame, groups: DataFrame) -> DataFrame:
    levels = cut(levels_of(found))
    sizes = levels.groupBy("lang", "source", "count").agg(F.sum(F.bitmap_count("bits")).alias("size"))
    sizes = sizes.groupBy("lang", "source").agg(F.collect_list("count").alias("counts"), F.collect_list("size").alias("sizes"))
    every = _tiled(groups.join(sizes, ["lang", "source"], "left"))
    key = ["lang", "lo", "hi"]
    every = every.select(*key, "set", "source", "terms", "whole", "counts", "sizes").repartition(width(found), *key).sortWithinPartitions(*key, "source")
    joint = _tiled(levels.join(groups, ["lang", "source"])).select(*TILE, "set", "source", "whole", "count", "bits")
    joint = joint.repartition(width(found), *TILE).sortWithinPartitions(*TILE, "source")
    return every.mapInArrow(_with_zeros, PAIR_SCHEMA).unionByName(joint.mapInArrow(_joint, PAIR_SCHEMA))
