"""Streams: an inbox without repeats, delivery gates, rolling contexts, codes redeemed in time, activity windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calspark.operators.saved import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the schema of the table; as a pattern, the path may be a file or a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives until its source has no more, written by the file sink or, in other modes, batch by batch."""
    spark = stream.sparkSession
    place = folder(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{place}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{place}/out/n={batch}"))
    writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


def last_batch(rows: DataFrame) -> DataFrame:
    """Of a drained stream in complete mode, the final state."""
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch", "n")


def without_repeats(stream: DataFrame, key: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; state is kept for as long as repeats may come."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


#: Parts that stored keys are dealt to: a batch reads those that its own keys fall into.
KEY_PARTS = 64


def once_for_good(stream: DataFrame, key: list[str], place: str, order: str, done: Column | None = None):
    """A writer of the first row of each key (by ``order``) to place/rows, however late another one comes, also after a restart.

    Keys are kept as files by part and batch; a batch that is tried again replaces its own and doesn't see them. Rows that
    are not ``done`` (those that failed) are written and leave their key open for another try.
    """
    spark = stream.sparkSession
    part = F.pmod(F.xxhash64(*key), F.lit(KEY_PARTS)).cast("int").alias("part")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in stream.select(*key).dtypes), "batch long, part int"])

    def run(rows: DataFrame, batch: int) -> None:
        stored = spark.read.schema(schema).option("basePath", f"{place}/keys").parquet(f"{place}/keys") if exists else None
        ok = F.lit(True) if done is None else F.coalesce(done, F.lit(False))
        rows = rows.withColumns({"_done": ok, "_part": part})
        if stored is not None:
            known = stored.filter(F.col("batch") < batch).select(*key, F.col("part").alias("_part"))
            rows = rows.join(known, ["_part", *key], "left_anti")
        first = F.min(F.when(F.col("_done"), F.struct(order))).over(Window.partitionBy(*key))
        rows = rows.withColumn("_first", first).filter(F.col("_first").isNull() | (F.struct(order) <= F.col("_first"))).dropDuplicates([*key, order])
        rows.drop("_done", "_part", "_first").write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")
        new = spark.read.parquet(f"{place}/rows/batch={batch}").withColumns({"_done": ok, "part": part}).filter("_done").select(*key, "part")
        for_batch = new.withColumn("batch", F.lit(batch).cast("long"))
        for_batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(f"{place}/keys")
        nonlocal_exists()

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/keys")
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def nonlocal_exists() -> None:
        nonlocal exists
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{place}/state")


def kept_once(stream: DataFrame, key: list[str], order: str, place: str | None = None, done: Column | None = None) -> DataFrame:
    """What ``once_for_good`` has written when the source has no more."""
    place = place or folder(stream.sparkSession)
    once_for_good(stream, key, place, order, done).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/rows").drop("batch")


def redeemed(issued: DataFrame, used: DataFrame, minutes: int = 10) -> DataFrame:
    """Codes used within so many minutes of being issued: (user_id, issue_id, issued_at) with (user_id, use_id, used_at)."""
    left = issued.withWatermark("issued_at", "1 hour")
    right = used.withColumnRenamed("user_id", "by_user").withWatermark("used_at", "1 hour")
    in_time = F.expr(f"used_at >= issued_at AND used_at <= issued_at + interval {minutes} minutes")
    return left.join(right, (F.col("user_id") == F.col("by_user")) & in_time).select("user_id", "issue_id", "use_id")


def activity(stream: DataFrame, at: str, size: str, slide: str | None = None) -> DataFrame:
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, "1 day").groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))


def sessions(stream: DataFrame, at: str, gap: str) -> DataFrame:
    return stream.withWatermark(at, "1 hour").groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "n")


def last_turns(stream: DataFrame, keep: int = 6) -> DataFrame:
    """account_id, seen and turns: the latest few turns of an account whenever it has new ones."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, turns = state.get if state.exists else (0, [])
        for batch in batches:
            seen += len(batch)
            turns = sorted({*turns, *batch["turn_id"].tolist()})[-keep:]
        state.update((seen, turns))
        yield pd.DataFrame({"account_id": [key[0]], "seen": [seen], "turns": [turns]})

    return stream.groupBy("account_id").applyInPandasWithState(run, "account_id long, seen long, turns array<long>", "seen long, turns array<long>", "append", GroupStateTimeout.NoTimeout)


def gated(stream: DataFrame, horizon: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Decisions of a delivery gate for each event: a reminder is sent if none is unanswered, and an answer opens the gate.

    ``stream`` has event_id, at, kind (reminder or ack) and item_id; rows of a batch are taken in order of time. An event of which
    nothing was heard for the horizon is forgotten: a timer on event time ends its state.
    """
    milliseconds = int(pd.Timedelta(horizon).total_seconds() * 1000)

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting, latest = state.get if state.exists else (False, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "item_id"])
        for kind, item in zip(rows["kind"], rows["item_id"], strict=True):
            if kind == "ack":
                waiting = False
            else:
                out.append((key[0], item, "blocked" if waiting else "send"))
                waiting = True
        latest = max(latest, int(rows["at"].max().timestamp() * 1000))
        state.update((waiting, latest))
        state.setTimeoutTimestamp(max(latest + milliseconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "item_id", "decision"])

    stream = stream.withWatermark("at", delay)
    return stream.groupBy("event_id").applyInPandasWithState(run, "event_id long, item_id long, decision string", "waiting boolean, latest long", "append", GroupStateTimeout.EventTimeTimeout)
