"""Product statistics over linked accounts: subjects, first days, retention, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(*sources: DataFrame) -> DataFrame:
    """The least ``seen_at`` of each subject over all sources (subject, seen_at)."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.groupBy("subject").agg(F.min("seen_at").alias("registered_at"))


def week_three(registered: DataFrame, activity: DataFrame, snapshot: str, now: str) -> DataFrame:
    """subject and retained: registered after the snapshot and 21 days ago at least; active from day 14 to before day 21."""
    day = lambda n: F.col("registered_at") + F.expr(f"interval {n} days")
    cohort = registered.filter((F.col("registered_at") > F.lit(snapshot).cast("timestamp_ntz")) & (day(21) <= F.lit(now).cast("timestamp_ntz")))
    joined = cohort.join(activity, "subject", "left")
    hit = (F.col("active_at") >= day(14)) & (F.col("active_at") < day(21))
    return joined.groupBy("subject").agg(F.max(F.coalesce(hit, F.lit(False))).alias("retained"))


def blended(cohort: DataFrame, past_users: int, past_share: float) -> DataFrame:
    """The share of retained subjects together with a past cohort, in percent to one decimal."""
    n, r = F.count(F.lit(1)), F.sum(F.col("retained").cast("int"))
    return cohort.agg(n.alias("cohort"), r.alias("retained"), F.round((past_users * past_share / 100 + r) / (past_users + n) * 100, 1).alias("percent"))


def grown(past: int, now: DataFrame, column: str, at_start: int) -> DataFrame:
    """past + what has come since the snapshot, never less than nothing."""
    return now.select((F.lit(past) + F.greatest(F.col(column) - at_start, F.lit(0))).alias("total"))
