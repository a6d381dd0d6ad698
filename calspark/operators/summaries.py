"""Day and week plans, overlaps, free days and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bucketed_overlaps, ntz


def plan_rows(entries: DataFrame, first: str, days: int, now: str) -> DataFrame:
    """What is on each day: unfinished entries that are not over; all-day ones on each of their days, others where they start."""
    lo = F.lit(first).cast("date")
    open_ = entries.filter(~F.col("is_completed") & (F.col("end_at") > ntz(now)))
    last = F.to_date(F.greatest(F.col("end_at") - F.expr("interval 1 second"), F.col("start_at")))
    spread = F.when(F.col("all_day"), F.sequence(F.to_date("start_at"), last)).otherwise(F.array(F.to_date("start_at")))
    return open_.withColumn("day", F.explode(spread)).filter((F.col("day") >= lo) & (F.col("day") < F.date_add(lo, days)))


def free_days(plan: DataFrame, subjects: DataFrame, first: str, days: int) -> DataFrame:
    """Days without anything on them, for each subject."""
    spine = subjects.select("subject", F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days - 1))).alias("day"))
    return spine.join(plan.select("subject", "day").distinct(), ["subject", "day"], "left_anti")


def day_overlaps(plan: DataFrame) -> DataFrame:
    """Pairs of timed rows of a subject's day that overlap."""
    timed = plan.filter(~F.col("all_day")).withColumn("key", F.concat_ws("|", "subject", F.col("day").cast("string")))
    found = bucketed_overlaps(timed.select("key", "subject", "day", "event_id", "start_at", "end_at"), timed.select("key", "event_id", "start_at", "end_at"), "key")
    return found.filter("a.event_id < b.event_id").select("a.subject", "a.day", F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"))


def week_totals(plan: DataFrame) -> DataFrame:
    """Rows of a week for each subject; events of equal times and title count once."""
    return plan.groupBy("subject").agg(F.countDistinct("start_at", "end_at", "title").alias("n_events"), F.sum(F.col("all_day").cast("int")).alias("n_all_day"))


def digest(plan: DataFrame, most: int) -> DataFrame:
    """Lines of each subject's day, all-day rows first, the first few and how many more there are."""
    place = F.row_number().over(Window.partitionBy("subject", "day").orderBy(F.desc("all_day"), "start_at", "event_id"))
    line = F.concat(F.when(F.col("all_day"), "all day").otherwise(F.date_format("start_at", "HH:mm")), F.lit(" "), F.col("title"))
    ranked = plan.withColumns({"place": place, "line": line})
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "line"))))
    days = ranked.groupBy("subject", "day").agg(F.count(F.lit(1)).alias("n"), shown.alias("shown"))
    return days.select("subject", "day", F.array_join(F.transform("shown", lambda x: x["line"]), "\n").alias("text"), F.greatest(F.col("n") - most, F.lit(0)).alias("n_more"))


def page(history: DataFrame, key: str, size: int, number: int) -> DataFrame:
    """A page of each key's history, newest first, and whether there is more behind it."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), "ref")
    ranked = history.withColumns({"place": F.row_number().over(w), "more": F.lead("ref").over(w).isNotNull()})
    return ranked.filter((F.col("place") > size * number) & (F.col("place") <= size * (number + 1)))
