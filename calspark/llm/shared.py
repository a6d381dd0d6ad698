"""What the corpus operators have in common: tables, checkpoints, streams of grouped rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone; null text becomes empty, other columns (whatever their names) are ignored."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session without it gets its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:  # set on the session, after its context was made
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_between_stages(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or something like it that is no column of ``df`` in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column (its name is returned) that no two rows share: doc_id where it is one row's alone, else a number beyond all ids.

    Rows that repeat both id and text are one row. Rows without an id or with another's are checkpointed, so their
    numbers hold; a table where every row has its own id is only counted.
    """
    own = free_name(df, "row_id")
    ids = df.select(F.col("doc_id").cast("long").alias(own))
    several = cut(ids.groupBy(own).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(own).isNull()).select(own))
    rows = df.withColumn(own, F.col("doc_id").cast("long"))
    if several.isEmpty():
        return rows, own
    low, top = ids.agg(F.coalesce(F.min(own), F.lit(0)), F.coalesce(F.max(own), F.lit(0))).first()
    others = rows.join(several, own, "left_semi").unionByName(rows.filter(F.col(own).isNull())).dropDuplicates([own, "text"])
    number = F.monotonically_increasing_id()
    others = cut(others.withColumn(own, F.lit(top + 1) + number if top < 2**62 else F.lit(low - 1) - number))
    return rows.filter(F.col(own).isNotNull()).join(several, own, "left_anti").unionByName(others), own


def width(df: DataFrame) -> int:
    """Partitions that a shuffle gets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a key that any task can take.
HOT_ROWS = 64


def hot_and_usual(df: DataFrame, found: DataFrame, n: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``found`` (a row for each key, with the number of its rows) by whether a key has more than its share of ``total`` rows.

    As the shares of hot keys add up to ``total``, they are fewer than the partitions of a shuffle: they may be broadcast.
    """
    share = max(HOT_ROWS, total // width(df))
    return F.broadcast(found.filter(F.col(n) > share)), found.filter(F.col(n) <= share)


def joined(rows: DataFrame, found: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a row for each key, which has their number ``n``; rows of hot keys are not shuffled."""
    hot, usual = hot_and_usual(rows, found, n, total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(usual, keys))


def smallest_hashes(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The rows with the smallest hashes of the columns, ``limit`` at most; rows equal in them count once.

    Only hashes are ordered: the rows themselves are filtered by the last of them, wherever they are.
    """
    h = F.xxhash64(*columns)
    last = df.select(h.alias("h")).distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return df.filter(h <= F.lit(last).cast("long")).dropDuplicates(list(columns))


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the bytes of ``column`` would exceed ``limit``: a row is never split."""
    for batch in batches:
        values = batch.column(column)
        ends = np.cumsum(value_sizes(values))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def value_sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begins, lengths)


def in_bitmap(bitmap: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether each value may be a key of the bitmap; without one, all may."""
    if bitmap is None:
        return np.ones(len(h), bool)
    bit = h % (len(bitmap) * 8)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


#: Bits for each key, and of a bitmap, at most (64 MB): more keys than a fourth of these are joined without it.
KEY_BITS, MOST_BITS = 16, 1 << 29


def bits_for(keys: int, most: int = MOST_BITS) -> int | None:
    """The bits of a bitmap that lets hardly any other key through; None where it would have to be too large."""
    bits = max(1 << 16, -(-keys * KEY_BITS // 32768) * 32768)
    return min(bits, most) if keys * 4 <= most else None


def bitmap_of(df: DataFrame, column: str, bits: int | None) -> np.ndarray | None:
    """A bit for each value of the column, modulo ``bits`` (a multiple of 32768), whatever the rows; None without bits."""
    if bits is None:
        return None
    at = F.pmod(column, F.lit(bits)) + 1  # positions are counted from 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        first = (r["bucket"] - 1) * 4096
        part = np.frombuffer(r["bits"], np.uint8)
        out[first: first + len(part)] |= part[: len(out) - first]
    return out


def with_rows(base: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``base`` that have none of ``found`` (by doc_id and text_hash), as far as a bitmap tells, and all others joined with it."""
    touched = bitmap_of(found, "text_hash", bits_for(found.count()))

    def only(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(touched, batch.column("text_hash").to_numpy()) == inside))

        return run

    schema = "doc_id long, text_hash long, text binary"
    other = found.withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_hash", "own_hash")
    texts = base.mapInArrow(only(True), schema)
    same = texts["doc_id"].eqNullSafe(other["own_id"]) & (texts["text_hash"] == other["own_hash"])
    return base.mapInArrow(only(False), schema), texts.join(other, same, "left").drop("own_id", "own_hash")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, one key after the other, from rows sorted by it: only one group is held at a time."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if kept and first != last:
            yield _one(kept)
            kept = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a:
                yield _one(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if kept:
        yield _one(kept)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
