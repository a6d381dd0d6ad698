"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting white space; its UTF-8 bytes are hashed as polynomials modulo two primes. The
hash of a concatenation follows from the hashes of its parts, H(AB) = H(A) * r^|B| + H(B), so a huge text is cut
into chunks that are normalised and hashed in parallel and joined by length-shifted arithmetic. Texts with equal
fingerprints are then compared chunk by chunk with the document that would stay; whatever differs is grouped by
its whole content instead. Only texts whose fingerprint is in a bitmap of repeated ones are shuffled for that (sized
by their number, of 64 MB at most, made by Spark, broadcast); it may let others through, which a join then removes,
and beyond 134 million repeated fingerprints that join alone decides. The rows of a large group are dealt to several
tasks from the start (a salt), each with its own copy of the text that stays.

Defined cases: null text counts as empty, all empty texts are equal; a null doc_id is an id like any other and
sorts last; repeated rows each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_of, bits_for, cut, documents, hot_and_usual, in_bitmap, own_ids, pieces_of, width

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes hashed by one task at a time.
CHUNK_BYTES = 1 << 16
#: Two primes under 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 741103597)
#: Copies of one text that are compared in one task, and their bytes.
GROUP_ROWS, GROUP_BYTES = 4096, 1 << 25
BATCH_BYTES = 8_000_000


class Polynomial:
    """Hashes of bytes as polynomials modulo two primes."""

    def __init__(self, primes=PRIMES, bases=BASES, chunk_bytes: int = CHUNK_BYTES):
        self.primes, self.bases = primes, bases
        self.powers = []
        for p, r in zip(primes, bases, strict=True):
            powers = np.ones(1, np.uint64)
            step = r % p  # r^len(powers)
            while len(powers) < chunk_bytes:
                powers = np.concatenate([powers, powers * np.uint64(step) % np.uint64(p)])
                step = step * step % p
            self.powers.append(powers[:chunk_bytes][::-1].copy())

    def chunk(self, data: bytes) -> tuple[int, int]:
        """Of at most CHUNK_BYTES bytes; products are under 2^40, so their sum fits into 64 bits."""
        symbols = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int(symbols @ w[len(w) - len(symbols):]) % p for w, p in zip(self.powers, self.primes, strict=True))

    def shifts(self, n_bytes: int) -> tuple[int, int]:
        """What the hash of a text is multiplied by when so many bytes follow."""
        return tuple(pow(r, n_bytes, p) for p, r in zip(self.primes, self.bases, strict=True))

    def joined(self, left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
        """H(AB) from H(A), H(B) and |B|."""
        return tuple((a * s + b) % p for a, b, s, p in zip(left, right, self.shifts(right_bytes), self.primes, strict=True))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _whole(polynomial: Polynomial, bitmap: np.ndarray | None, content: bool):
    """Normalises and hashes short texts; with a bitmap only texts in it come back; with ``content`` their bytes, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "piece", BATCH_BYTES):
            norm = [bytes(x.as_buffer()).translate(None, SPACES) for x in batch.column("piece")]
            h = np.array([polynomial.chunk(x) for x in norm], np.int64).reshape(-1, 2)
            at = np.flatnonzero(in_bitmap(bitmap, h[:, 0]))
            rows = pa.array(at)
            yield _batch({
                "doc_id": batch.column("doc_id").take(rows), "n_cp": batch.column("n_cp").take(rows),
                "n_bytes": pa.array([len(norm[i]) for i in at], pa.int64()), "h0": pa.array(h[at, 0]), "h1": pa.array(h[at, 1]),
                "text_sha256": pa.array([hashlib.sha256(norm[i]).hexdigest() for i in at], pa.string()),
                "norm": pa.array([norm[i] for i in at], pa.binary()) if content else pa.nulls(len(at), pa.binary()),
            })

    return run


def _chunks(polynomial: Polynomial):
    """Size, hash and shift of each chunk of a long text, after normalising it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [bytes(x.as_buffer()).translate(None, SPACES) for x in batch.column("piece")]
            found = np.array([(len(x), *polynomial.chunk(x), *polynomial.shifts(len(x))) for x in norm], np.int64).reshape(-1, 5)
            yield _batch({"row_id": batch.column("row_id"), "k": batch.column("k"), **{c: pa.array(found[:, i].copy()) for i, c in enumerate(("n", "h0", "h1", "s0", "s1"))}})

    return run


def fingerprints(df: DataFrame, polynomial: Polynomial, bitmap: np.ndarray | None = None, content: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_cp, n_bytes, h0, h1, text_sha256 and norm (null without ``content``) of every short row in the bitmap, or all; of long ones anyway."""
    base = documents(df).select("doc_id", F.char_length("text").alias("n_cp"), F.col("text").cast("binary").alias("piece"))
    schema = "doc_id long, n_cp int, n_bytes long, h0 long, h1 long, text_sha256 string, norm binary"
    short = base.filter(F.octet_length("piece") <= chunk_bytes).mapInArrow(_whole(polynomial, bitmap, content), schema)
    long = base.filter(F.octet_length("piece") > chunk_bytes).withColumn("row_id", F.monotonically_increasing_id())
    last = F.floor((F.octet_length("piece") - 1) / chunk_bytes).cast("int")
    chunk = long.select("row_id", "piece", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("row_id", "k", F.substring("piece", F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("piece"))
    chunk = chunk.repartition(width(df), "row_id", "k").mapInArrow(_chunks(polynomial), "row_id long, k int, n long, h0 long, h1 long, s0 long, s1 long")
    parts = chunk.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("k", "n", "h0", "h1", "s0", "s1"))).alias("parts"))
    zero = F.lit(0).cast("long")
    joined = F.aggregate("parts", F.struct(zero.alias("n"), zero.alias("h0"), zero.alias("h1")), lambda a, b: F.struct(
        (a["n"] + b["n"]).alias("n"), *(((a[f"h{i}"] * b[f"s{i}"] + b[f"h{i}"]) % p).alias(f"h{i}") for i, p in enumerate(polynomial.primes))))
    long = long.join(parts.select("row_id", joined.alias("j")), "row_id").withColumn("norm", F.regexp_replace(F.col("piece").cast("string"), "[ \\t-\\r]+", "").cast("binary"))
    long = long.select("doc_id", "n_cp", F.col("j.n").alias("n_bytes"), F.col("j.h0").alias("h0"), F.col("j.h1").alias("h1"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    return short.unionByName(long)


def _better() -> Column:
    """Greatest for the row that stays: most code points, then smallest doc_id."""
    return F.struct(F.col("n_cp"), F.coalesce(-F.col("doc_id"), F.lit(-(2**63) + 1)).alias("order"), F.col("doc_id"))


def _equal_by_chunks(a: str, b: str, n_bytes: str, chunk_bytes: int) -> Column:
    """Whether two texts of the same size are equal, one chunk after the other, up to the first that differs."""
    at = F.sequence(F.lit(0).cast("long"), F.floor(F.col(n_bytes) / chunk_bytes))
    cut_at = lambda c, k: F.substring(F.col(c), (k * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return F.forall(at, lambda k: cut_at(a, k) == cut_at(b, k))


def exact_duplicates(df: DataFrame, primes=PRIMES, bases=BASES, chunk_bytes: int = CHUNK_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    key, polynomial = ["h0", "h1", "n_bytes"], Polynomial(primes, bases, chunk_bytes)
    light = cut(fingerprints(df, polynomial, chunk_bytes=chunk_bytes).drop("norm"))
    several = light.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(_better()).alias("best")).filter("n > 1")
    salts = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("n") * F.col("n_bytes") / GROUP_BYTES)).cast("int")
    several = cut(several.select(*key, "n", F.col("best.doc_id").alias("keep_id"), F.least(salts, F.col("n").cast("int")).alias("salts")))
    several = several.withColumn("weight", F.col("n") * (F.col("n_bytes") + 64))
    repeats, total = several.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    # the texts of groups: the largest groups are known to all tasks and dealt to several
    large, _ = hot_and_usual(df, several, "weight", total)
    large = large.select(*key, "salts")
    repeated = fingerprints(df, polynomial, bitmap_of(several, "h0", bits_for(repeats)), True, chunk_bytes).join(large, key, "left")
    repeated = repeated.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_cp", F.spark_partition_id()), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = several.join(large.withColumnRenamed("salts", "parts"), key, "left").withColumn("salts", F.coalesce("parts", F.lit(1))).drop("parts")
    members = cut(repeated.join(spread.select(*key, "keep_id", "salts", every).hint("shuffle_hash"), [*key, "salt"]))
    models = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*key, "salts", F.col("norm").alias("model"))
    models = models.groupBy(*key).agg(F.first("salts").alias("salts"), F.first("model").alias("model"))
    same = members.join(models.select(*key, "model", every).hint("shuffle_merge"), [*key, "salt"]).withColumn("equal", _equal_by_chunks("norm", "model", "n_bytes", chunk_bytes))
    same = cut(same.select("doc_id", "n_cp", *key, "salt", "salts", "keep_id", "text_sha256", "equal", F.when(~F.col("equal"), F.col("norm")).alias("other")))
    sizes = same.filter("equal").groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.first("salts").alias("salts"))
    found = same.filter("equal").join(sizes.select(*key, "group_size", every), [*key, "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    # equal fingerprints of different texts: grouped by the whole content
    rest = same.filter("not equal")
    classes = rest.groupBy("other").agg(F.count(F.lit(1)).alias("group_size"), F.max(_better()).alias("best"), F.first("salts").alias("salts"))
    rest = rest.select("doc_id", "other", "salt", "text_sha256").join(classes.select("other", "group_size", "best", every), ["other", "salt"])
    rest = rest.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "text_sha256")
    alone = light.join(large.select(*key), key, "left_anti").join(several.select(*key), key, "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = alone.unionByName(found).unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_of_each(df: DataFrame) -> DataFrame:
    """One row of each class of copies, with all its columns; rows that share an id or have none are judged one by one."""
    rows, own = own_ids(df)
    gone = exact_duplicates(rows.select(F.col(own).alias("doc_id"), "text")).filter(~F.col("kept")).select(F.col("doc_id").alias(own))
    return rows.join(gone, own, "left_anti").select(*df.columns)
