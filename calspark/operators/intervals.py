"""Events as half-open intervals: defaults, overlaps, concurrency and lanes."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

DAY_SECONDS = 86400


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds(column: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone; the session's zone is UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_timestamp(column.cast("timestamp"))


def minutes_before(column: str | Column, minutes: int | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return column - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def confirmed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("status") == "confirmed")


def with_interval(events: DataFrame, timings: DataFrame, minutes: int = 30) -> DataFrame:
    """Events with start_at, end_at and all_day; without a timing they end at the deadline and start ``minutes`` before."""
    t = timings.select("event_id", F.col("start_at").alias("t_start"), F.col("end_at").alias("t_end"), F.col("all_day").alias("t_all_day"))
    joined = events.drop("start_at", "all_day").join(t, "event_id", "left")
    return joined.select(
        *[c for c in events.columns if c not in ("start_at", "all_day")],
        F.coalesce("t_start", minutes_before("deadline", minutes)).alias("start_at"),
        F.coalesce("t_end", "deadline").alias("end_at"),
        F.coalesce("t_all_day", F.lit(False)).alias("all_day"),
    )


def classified(entries: DataFrame, now: str) -> DataFrame:
    """is_past: over by now; is_upcoming: not completed and not begun."""
    return entries.withColumns({"is_past": F.col("end_at") <= ntz(now), "is_upcoming": ~F.col("is_completed") & (F.col("start_at") > ntz(now))})


def dyadic(first: Column, last: Column) -> Column:
    """The days from first to last as nodes (level, place) of a binary tree of days: two of each level at most, no level wider than they are."""
    highest = F.length(F.bin((last - first + 1).cast("long"))) - 1
    none = F.array().cast("array<struct<level: int, place: bigint>>")
    start = F.struct(first.cast("long").alias("l"), (last + 1).cast("long").alias("r"), none.alias("nodes"))

    def step(x: Column, level: Column) -> Column:
        open_ = x["l"] < x["r"]
        left, right = open_ & (F.pmod(x["l"], F.lit(2)) == 1), open_ & (F.pmod(x["r"], F.lit(2)) == 1)
        node = lambda on, place: F.when(on, F.array(F.struct(level.alias("level"), place.cast("long").alias("place")))).otherwise(none)
        return F.struct(
            F.shiftright(x["l"] + left.cast("int"), 1).alias("l"), F.shiftright(x["r"] - right.cast("int"), 1).alias("r"),
            F.concat(x["nodes"], node(left, x["l"]), node(right, x["r"] - 1)).alias("nodes"),
        )

    return F.when(first == last, F.array(F.struct(F.lit(0).alias("level"), first.cast("long").alias("place")))).otherwise(F.aggregate(F.sequence(F.lit(0), highest), start, step, lambda x: x["nodes"]))


def bucketed_overlaps(a: DataFrame, b: DataFrame, key: str, bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Pairs of rows of equal ``key`` whose intervals overlap; columns of a and b as structs ``a`` and ``b``.

    Of two intervals that overlap, the one that starts later starts inside the other. So each interval goes to the nodes of a tree of
    days that make it up (two a level, however long it is), and each start to the nodes above its day, as far as any interval
    is on their level; both are joined by key and node, and a busy key is spread over its days. A start lies
    in one node of an interval, so a pair comes once. Buckets narrower than a day spare comparisons where intervals are short.

    Both joins are by sorting: what was unfolded is taken for as small as the files it is from, and would be broadcast.
    """
    day = lambda c: F.floor(c / bucket_seconds)
    s, e = seconds("start_at"), seconds("end_at")

    def nodes(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.struct(*df.columns).alias(name), F.explode(dyadic(day(s), F.greatest(day(e - 1), day(s)))).alias("node"))

    used = nodes(a, "x").select("node.level").unionByName(nodes(b, "x").select("node.level")).agg(F.coalesce(F.collect_set("level"), F.array().cast("array<int>"))).scalar()

    def starts(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key), F.struct(*df.columns).alias(name), day(s).alias("day"), used.alias("levels"))
        above = F.transform("levels", lambda level: F.struct(level.alias("level"), F.floor(F.col("day") / F.pow(F.lit(2), level)).cast("long").alias("place")))
        return rows.select(key, name, F.explode(above).alias("node"))

    overlap = (F.col("a.start_at") < F.col("b.end_at")) & (F.col("a.end_at") > F.col("b.start_at"))
    later_a = starts(a, "a").join(nodes(b, "b").hint("merge"), [key, "node"]).filter(overlap & (F.col("a.start_at") >= F.col("b.start_at")))
    later_b = nodes(a, "a").join(starts(b, "b").hint("merge"), [key, "node"]).filter(overlap & (F.col("b.start_at") > F.col("a.start_at")))
    return later_a.select(key, "a", "b").unionByName(later_b.select(key, "a", "b"))


def conflicts(entries: DataFrame) -> DataFrame:
    """Pairs of timed events of one subject that overlap, the smaller id first."""
    timed = entries.filter(~F.col("all_day")).select("subject", "event_id", "start_at", "end_at")
    found = bucketed_overlaps(timed, timed, "subject").filter("a.event_id < b.event_id")
    return found.select("subject", F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"), F.greatest("a.start_at", "b.start_at").alias("from_at"), F.least("a.end_at", "b.end_at").alias("to_at"))


def long_overlaps(entries: DataFrame) -> DataFrame:
    """Events with the all-day events, or those of a day or more, of the same subject that they overlap; a warning, not a conflict."""
    one = entries.select("subject", "event_id", "start_at", "end_at")
    other = entries.filter(F.col("all_day") | (seconds("end_at") - seconds("start_at") >= DAY_SECONDS)).select("subject", "event_id", "start_at", "end_at")
    found = bucketed_overlaps(one, other, "subject").filter("a.event_id <> b.event_id")
    return found.select("subject", F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("long_id"))


def near_deadlines(events: DataFrame, band_seconds: int = 3600) -> DataFrame:
    """Pairs of confirmed events of one user with deadlines less than the band apart, by buckets as wide as the band."""
    e = confirmed(events).select("user_id", "event_id", seconds("deadline").alias("at"))
    left = e.select("user_id", F.col("event_id").alias("event_a"), F.col("at").alias("at_a"), F.explode(F.sequence(F.floor(F.col("at") / band_seconds) - 1, F.floor(F.col("at") / band_seconds) + 1)).alias("bucket"))
    right = e.select("user_id", F.col("event_id").alias("event_b"), F.col("at").alias("at_b"), F.floor(F.col("at") / band_seconds).alias("bucket"))
    found = left.join(right, ["user_id", "bucket"]).filter((F.col("event_a") < F.col("event_b")) & (F.abs(F.col("at_a") - F.col("at_b")) < band_seconds))
    return found.select("user_id", "event_a", "event_b")


def peak_concurrency(entries: DataFrame) -> DataFrame:
    """The most events at one time, for each subject and day of start."""
    timed = entries.filter(~F.col("all_day")).withColumn("day", F.to_date("start_at"))
    steps = timed.select("subject", "day", F.explode(F.array(F.struct(F.col("start_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_at").alias("at"), F.lit(-1).alias("step")))).alias("x")).select("subject", "day", "x.*")
    running = F.sum("step").over(Window.partitionBy("subject", "day").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("running", running).groupBy("subject", "day").agg(F.max("running").alias("peak"))


def lanes(entries: DataFrame) -> DataFrame:
    """The least free lane of each timed event of a day, in order of start; a lane is free when its last event is over.

    Events without a start or an end have no lane.
    """
    timed = entries.filter(~F.col("all_day") & F.col("start_at").isNotNull() & F.col("end_at").isNotNull())
    rows = timed.select("subject", F.to_date("start_at").alias("day"), "event_id", seconds("start_at").alias("s"), seconds("end_at").alias("e"))

    def placed(state: list, s: int, e: int) -> int:
        busy, free = state  # heaps of (end, lane) and of lanes that were used before
        while busy and busy[0][0] <= s:
            heappush(free, heappop(busy)[1])
        lane = heappop(free) if free else len(busy)
        heappush(busy, (e, lane))
        return lane

    out = folded(rows, ["subject", "day"], ["s", "e", "event_id"], ["s", "e"], "lane", lambda: [[], []], placed)
    return out.select("subject", "day", "event_id", F.col("lane").cast("int").alias("lane"))
