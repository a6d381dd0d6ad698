"""When to remind of an event, and what to do with reminders that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import ntz

# Minutes before the start, most reminders by preference, most valid times.
STANDARD = (1440, 720, 60, 30, 15)
LIMITS = {"minimal": 1, "balanced": 2, "frequent": 3}
MOST_VALID = 4


def before(column: str, minutes: int) -> Column:
    return F.col(column) - F.expr(f"interval {minutes} minutes")


def standard(events: DataFrame) -> DataFrame:
    """A row for each standard time before each event."""
    return events.withColumn("remind_at", F.explode(F.array(*(before("start_at", m) for m in STANDARD))))


def legacy(events: DataFrame, now: str) -> DataFrame:
    """The standard times before deadlines that are still to come, and now itself if less than a day is left."""
    times = events.withColumn("remind_at", F.explode(F.array(*(before("deadline", m) for m in STANDARD)))).filter(F.col("remind_at") > ntz(now))
    soon = events.filter((F.col("deadline") > ntz(now)) & (F.col("deadline") < ntz(now) + F.expr("interval 24 hours"))).withColumn("remind_at", ntz(now))
    return times.unionByName(soon)


def contextual(events: DataFrame, important: str, prepared: str) -> DataFrame:
    """Times by the kind of event: ``important`` and ``prepared`` are patterns of titles."""
    evening = F.date_trunc("day", "start_at").cast("timestamp_ntz") - F.expr("interval 4 hours")
    morning = F.hour("start_at") <= 10
    title = F.lower("title")
    times = (
        F.when(title.rlike(important), F.array(before("start_at", 2880), before("start_at", 1440), evening, before("start_at", 180)))
        .when(title.rlike(prepared), F.array(before("start_at", 1440), evening, before("start_at", 360)))
        .when(morning, F.array(evening, before("start_at", 60)))
        .otherwise(F.array(before("start_at", 180), before("start_at", 60)))
    )
    return events.withColumn("remind_at", F.explode(times))


def all_day(events: DataFrame, now: str) -> DataFrame:
    """The evening before at seven, or nine o'clock of the day when that is over."""
    day = F.date_trunc("day", "start_at").cast("timestamp_ntz")
    evening = day - F.expr("interval 5 hours")
    return events.withColumn("remind_at", F.when(evening > ntz(now), evening).otherwise(day + F.expr("interval 9 hours")))


def valid(rows: DataFrame, now: str) -> DataFrame:
    """Times between now and the start, to the minute, once each; the earliest few of each event."""
    kept = rows.filter((F.col("remind_at") > ntz(now)) & (F.col("remind_at") < F.col("start_at")))
    kept = kept.withColumn("remind_at", F.date_trunc("minute", "remind_at").cast("timestamp_ntz")).select("event_id", "remind_at").distinct()
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("remind_at"))
    return kept.withColumn("place", place).filter(F.col("place") <= MOST_VALID).drop("place")


def capped(rows: DataFrame, preferences: DataFrame) -> DataFrame:
    """The latest few times of each event that its account's preference allows; none where they are switched off."""
    limit = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))[F.col("frequency")]
    joined = rows.join(preferences.filter("enabled").select("account_id", limit.alias("most")), "account_id")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("remind_at")))
    return joined.withColumn("place", place).filter(F.col("place") <= F.col("most")).drop("place", "most")


def decided(reminders: DataFrame, events: DataFrame, waiting: DataFrame, now: str) -> DataFrame:
    """expire, blocked or send for each reminder that is pending and due or stale; one send for each event.

    ``waiting`` has the events whose last reminder is unanswered. Reminders of completed or started events expire.
    """
    e = events.select("event_id", "status", "is_completed", "start_at").withColumnRenamed("status", "event_status")
    rows = reminders.filter("status = 'pending'").join(e, "event_id").join(waiting.select("event_id", F.lit(True).alias("waits")), "event_id", "left")
    over = F.col("is_completed") | (F.col("start_at") <= ntz(now))
    due = (F.col("remind_at") <= ntz(now)) & (F.col("event_status") == "confirmed")
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("remind_at", "reminder_id")) == 1
    rows = rows.withColumn("over", over).filter(F.col("over") | due)
    return rows.withColumn("decision", F.when(F.col("over"), "expire").when(F.coalesce("waits", F.lit(False)), "blocked").when(first, "send").otherwise("blocked"))


def acknowledged(reminders: DataFrame, acks: DataFrame, now: str) -> DataFrame:
    """Overdue pending reminders of acknowledged events become sent."""
    rows = reminders.join(acks.select("event_id", F.lit(True).alias("acked")), "event_id", "left")
    done = F.coalesce("acked", F.lit(False)) & (F.col("status") == "pending") & (F.col("remind_at") <= ntz(now))
    return rows.withColumn("status", F.when(done, "sent").otherwise(F.col("status"))).drop("acked")


def snoozed(reminders: DataFrame, snoozes: DataFrame, now: str) -> DataFrame:
    """The reminders of snoozed events collapse into one at now + minutes; a snooze that is not before the start is rejected.

    ``snoozes`` has event_id, minutes and start_at. Rows have accepted: null where the event isn't snoozed.
    """
    s = snoozes.withColumn("new_at", ntz(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")))
    s = s.withColumn("accepted", F.col("new_at") < F.col("start_at")).select("event_id", "new_at", "accepted")
    rows = reminders.join(s, "event_id", "left")
    collapsed = rows.filter("accepted AND status = 'pending'").filter(F.col("remind_at") <= F.col("new_at"))
    new = s.filter("accepted").select("event_id", F.col("new_at").alias("remind_at"), F.lit("pending").alias("status"))
    kept = rows.join(collapsed.select("reminder_id"), "reminder_id", "left_anti").select("event_id", "remind_at", "status")
    return kept.unionByName(new)
