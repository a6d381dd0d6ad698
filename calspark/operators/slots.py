"""Slots of an imported timetable: checks, duplicates, confirmation and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions import text as T

from .saved import saved

SIGNATURE = ["title", "weekday", "start_min", "end_min", "week_pattern"]


def reject_reason(least_confidence: float) -> Column:
    """Why a slot can't be taken, or null."""
    return (
        F.when(F.col("end_min") <= F.col("start_min"), "end")
        .when(F.col("weekday").isNull() & F.col("occurrence_date").isNull(), "day")
        .when(F.col("confidence") < least_confidence, "confidence")
    )


def dated(slots: DataFrame) -> DataFrame:
    """A slot with a date has its weekday and no parity."""
    there = F.col("occurrence_date").isNotNull()
    return slots.withColumns({"weekday": F.when(there, F.weekday("occurrence_date")).otherwise(F.col("weekday")), "week_pattern": F.when(there, "every").otherwise(F.col("week_pattern"))})


def first_of_each(slots: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return slots.withColumn("_place", place).filter("_place = 1").drop("_place")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return first_of_each(rows, [key], [F.desc(order)])


def confirmed(slots: DataFrame, series: DataFrame) -> DataFrame:
    """New series of confirmed drafts: once each in a batch, and not what is there already."""
    new = first_of_each(slots, ["draft_id", *SIGNATURE], ["position"])
    return new.join(series.select("account_id", *SIGNATURE), ["account_id", *SIGNATURE], "left_anti").withColumn("source", F.concat(F.lit("schedule_import:"), F.col("draft_id").cast("string")))


def undone(series: DataFrame, sources: DataFrame) -> DataFrame:
    """Series without those that the given imports made."""
    return series.join(sources.select("source"), "source", "left_anti").select(*series.columns)


#: Requests and classes of a tile at most, and pairs that a task makes of its tiles on average.
TILE, PAIRS_OF_A_TASK = (256, 512), 1 << 25


def in_blocks(rows: DataFrame, key: list[str], own: list[str], most: int, no: str) -> DataFrame:
    """Up to ``most`` rows of equal ``key`` in one row: arrays of the columns ``own``, nulls included, and the block's number ``no``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*own))
    blocks = rows.withColumn(no, F.floor((place - 1) / most)).groupBy(*key, no).agg(F.collect_list(F.struct(*own)).alias("_rows"))
    return blocks.select(*key, no, *(F.col("_rows").getField(c).alias(c) for c in own))


def skip_candidates(requests: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """The classes that each request to skip one can mean: request_id and the columns of ``classes`` but ``on``, which can be sorted.

    ``requests`` has request_id (unique), ``on`` and message, ``classes`` has ``on`` and title; both meet where ``on`` is equal.
    Classes that share a word with the message, beside those of any such request, are meant; where none does, all are. A null message or title has no words.
    """
    own = [c for c in classes.columns if c not in on]
    asked = requests.select("request_id", *on, F.coalesce("message", F.lit("")).alias("_said"))
    there = classes.withColumn("_named", F.coalesce("title", F.lit("")))
    # what is said is compared once for each group, whoever says it
    wanted = F.array_except(T.plain_words("_said"), F.array(*map(F.lit, T.SKIP_WORDS)))
    said = asked.groupBy(*on, "_said").agg(F.count(F.lit(1)).alias("_asked")).withColumn("_wanted", wanted)
    named = there.groupBy(*on, "_named").agg(F.count(F.lit(1)).alias("_there")).withColumn("_has", T.plain_words("_named"))
    shared = F.arrays_overlap("_wanted", "_has")
    sets = said.join(named.hint("merge"), on).groupBy(*on, "_said", "_asked")
    sets = saved(sets.agg(F.collect_list(F.when(shared, F.col("_named"))).alias("_meant"), F.coalesce(F.sum(F.when(shared, F.col("_there"))), F.sum("_there")).alias("_each")))
    pairs = sets.agg(F.sum(F.col("_asked").cast("double") * F.col("_each"))).first()[0] or 0
    # there can be far more pairs than input: blocks of requests meet blocks of classes, and these tiles are dealt out by the pairs they make
    asked = asked.join(sets.select(*on, "_said", (F.size("_meant") == 0).alias("_any")).hint("merge"), [*on, "_said"])
    some = in_blocks(asked.filter("NOT _any"), [*on, "_said"], ["request_id"], TILE[0], "_i")
    some = some.join(sets.select(*on, "_said", F.explode("_meant").alias("_named")).hint("merge"), [*on, "_said"])
    some = some.join(in_blocks(there, [*on, "_named"], own, TILE[1], "_j").hint("merge"), [*on, "_named"])
    every = in_blocks(asked.filter("_any"), on, ["request_id"], TILE[0], "_i").join(in_blocks(classes, on, own, TILE[1], "_j").hint("merge"), on)
    tile = lambda rows, *key: rows.select("request_id", *own, F.xxhash64(*on, *key, "_i", "_j").alias("_tile"))
    tiles = tile(some, "_said", "_named").unionByName(tile(every)).repartition(max(1, min(20_000, round(pairs / PAIRS_OF_A_TASK))), "_tile")
    made = tiles.select(F.explode("request_id").alias("request_id"), *own).select("request_id", *own[1:], F.posexplode(own[0]).alias("_at", own[0]))
    return made.select("request_id", own[0], *(F.col(c)[F.col("_at")].alias(c) for c in own[1:]))
