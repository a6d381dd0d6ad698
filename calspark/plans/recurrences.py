"""Queries over recurring classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calspark.operators import intervals, recurrence
from calspark.operators.intervals import bucketed_overlaps

from .calendar import ENTRIES, entries
from .registry import query
from .views import Tables

FIRST, LAST = "2023-12-15", "2025-01-19"  # 31 days before and 370 days after now
SEMESTER = """CASE WHEN month(valid_from) >= 9 OR month(valid_from) = 1
  THEN make_date(CAST(year(valid_from) - CASE WHEN month(valid_from) = 1 THEN 1 ELSE 0 END AS INT), 9, 1)
       + CASE WHEN isodow(make_date(CAST(year(valid_from) - CASE WHEN month(valid_from) = 1 THEN 1 ELSE 0 END AS INT), 9, 1)) = 7 THEN 1 ELSE 0 END
  ELSE valid_from END"""
WEEKLY = f"""
spans AS (SELECT *, greatest(valid_from, DATE '{FIRST}') AS lo, least(valid_until, DATE '{LAST}') AS hi, {SEMESTER} AS semester FROM v_series
  WHERE valid_from <= DATE '{LAST}' AND valid_until >= DATE '{FIRST}'),
weekly AS (SELECT *, CAST(unnest(generate_series(CAST(lo + CAST((weekday - (isodow(lo) - 1) + 7) % 7 AS INT) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS occurrence_date FROM spans),
numbered AS (SELECT *, CAST(floor((occurrence_date - (semester - CAST(isodow(semester) - 1 AS INT))) / 7.0) AS INT) + 1 AS week FROM weekly),
fitting AS (SELECT * FROM numbered WHERE week_pattern = 'every' OR (week_pattern = 'odd' AND week % 2 = 1) OR (week_pattern = 'even' AND week % 2 = 0)),
occurrences AS (SELECT f.*, CAST(occurrence_date AS TIMESTAMP) + to_minutes(start_min) AS start_at, CAST(occurrence_date AS TIMESTAMP) + to_minutes(end_min) AS end_at,
  's:' || CAST(series_id AS VARCHAR) || ':' || CAST(occurrence_date AS VARCHAR) AS ref
  FROM fitting f WHERE NOT EXISTS (SELECT 1 FROM v_series_exceptions x WHERE x.series_id = f.series_id AND x.occurrence_date = f.occurrence_date))"""


def classes(t: Tables) -> DataFrame:
    return recurrence.occurrences(t.series, t.series_exceptions, FIRST, LAST)


@query("r1_weekly_expansion", f"WITH {WEEKLY} SELECT series_id, occurrence_date FROM weekly")
def _(t):
    return recurrence.expanded(t.series, FIRST, LAST).select("series_id", "occurrence_date")


@query("r2_week_parity", f"WITH {WEEKLY} SELECT series_id, occurrence_date, week FROM fitting")
def _(t):
    rows = recurrence.expanded(t.series, FIRST, LAST).withColumn("week", recurrence.academic_week("valid_from", "occurrence_date"))
    return rows.filter(recurrence.matches_week("week_pattern", "week")).select("series_id", "occurrence_date", "week")


@query("r3_academic_week", f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS day FROM orders), s AS (SELECT *, {SEMESTER} AS semester FROM d)
SELECT o_orderkey, CAST(semester AS DATE) AS semester, CAST(floor((day - (semester - CAST(isodow(semester) - 1 AS INT))) / 7.0) AS INT) + 1 AS week FROM s""")
def _(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("valid_from")).withColumn("day", F.date_add("valid_from", (F.col("o_orderkey") % 90).cast("int")))
    return d.select("o_orderkey", recurrence.semester_start("valid_from").alias("semester"), recurrence.academic_week("valid_from", "day").alias("week"))


@query("r4_week_marks", f"""
WITH {WEEKLY} SELECT series_id, occurrence_date FROM fitting WHERE (series_id % 6 = 0 AND week NOT IN (18, 20, 21, 24)) OR (series_id % 6 = 1 AND week IN (19, 22))""")
def _(t):
    weeks = F.when(F.col("series_id") % 6 == 0, F.array(*map(F.lit, (18, 20, 21, 24))))
    out = F.when(F.col("series_id") % 6 == 1, F.array(F.lit(19), F.lit(22)))
    return recurrence.skips_of_marks(t.series.withColumns({"weeks": weeks, "except_weeks": out}), FIRST, LAST)


@query("r5_occurrence_instants", f"""
WITH {WEEKLY} SELECT ref, start_at - INTERVAL 3 HOUR AS start_utc, end_at - INTERVAL 3 HOUR AS end_utc FROM occurrences""")
def _(t):
    utc = lambda c: F.convert_timezone(F.lit("Etc/GMT-3"), F.lit("UTC"), F.col(c))
    return classes(t).select("ref", utc("start_at").alias("start_utc"), utc("end_at").alias("end_utc"))


@query("r10_skip_once", """
WITH skips AS (SELECT series_id, CAST(valid_from + CAST(7 + (weekday - (isodow(valid_from) - 1) + 7) % 7 AS INT) AS DATE) AS occurrence_date FROM v_series WHERE series_id % 3 = 0)
SELECT series_id, occurrence_date, status FROM v_series_exceptions UNION ALL
SELECT s.series_id, s.occurrence_date, 'skipped' FROM skips s WHERE NOT EXISTS (SELECT 1 FROM v_series_exceptions x WHERE x.series_id = s.series_id AND x.occurrence_date = s.occurrence_date)""")
def _(t):
    day = F.date_add("valid_from", (7 + F.pmod(F.col("weekday") - F.weekday("valid_from"), F.lit(7))).cast("int"))
    return recurrence.skipped_once(t.series_exceptions, t.series.filter("series_id % 3 = 0").select("series_id", day.alias("occurrence_date")))


@query("r11_past_weekday", "SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN CAST(CAST(ts AS DATE) + 7 AS DATE) ELSE CAST(ts AS DATE) END AS day FROM events")
def _(t):
    return t.events.select("event_id", F.to_date("ts").alias("d")).select("event_id", recurrence.rolled("d", F.lit("2024-01-15").cast("date")).alias("day"))


@query("j9_event_class_overlap", f"""
WITH {ENTRIES}, {WEEKLY}, e AS (SELECT event_id, user_id % 75 AS account_id, start_at, end_at FROM entries WHERE NOT all_day)
SELECT e.event_id, o.ref FROM e JOIN occurrences o ON o.account_id = e.account_id AND e.start_at < o.end_at AND e.end_at > o.start_at""")
def _(t):
    e = entries(t).filter(~F.col("all_day")).select((F.col("user_id") % 75).alias("account_id"), "event_id", "start_at", "end_at")
    found = bucketed_overlaps(e, classes(t).select("account_id", "ref", "start_at", "end_at"), "account_id", 3600)
    return found.select("a.event_id", "b.ref")


@query("j10_exception_antijoin", f"WITH {WEEKLY} SELECT series_id, count(*) AS n FROM occurrences GROUP BY series_id")
def _(t):
    return classes(t).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("u2_events_and_classes", f"""
WITH {ENTRIES}, {WEEKLY} SELECT 'event' AS kind, CASE WHEN platform = 'a' THEN 't:' ELSE 'm:' END || CAST(event_id AS VARCHAR) AS ref, start_at, end_at FROM entries
UNION ALL SELECT 'class', ref, start_at, end_at FROM occurrences""")
def _(t):
    e = entries(t).select(F.lit("event").alias("kind"), F.concat_ws(":", F.when(F.col("platform") == "a", "t").otherwise("m"), F.col("event_id").cast("string")).alias("ref"), "start_at", "end_at")
    return e.unionByName(classes(t).select(F.lit("class").alias("kind"), "ref", "start_at", "end_at"), allowMissingColumns=True)


@query("r6_rule_expansion", """
WITH e AS (SELECT p_partkey AS uid, DATE '2024-01-01' + CAST(p_partkey % 60 AS INT) AS first_day, CASE WHEN p_partkey % 2 = 0 THEN 'DAILY' ELSE 'WEEKLY' END AS freq, CAST(1 + p_partkey % 3 AS INT) AS step, CAST(3 + p_size % 9 AS INT) AS n FROM part),
d AS (SELECT uid, freq, first_day, step, unnest(generate_series(0, n - 1)) AS i FROM e)
SELECT uid, false AS broken, CAST(first_day + CAST(i * step * CASE WHEN freq = 'DAILY' THEN 1 ELSE 7 END AS INT) AS DATE) AS day FROM d
WHERE first_day + CAST(i * step * CASE WHEN freq = 'DAILY' THEN 1 ELSE 7 END AS INT) < DATE '2024-06-01'""")
def _(t):
    e = t.part.select(F.col("p_partkey").alias("uid"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("first_day"), F.when(F.col("p_partkey") % 2 == 0, "DAILY").otherwise("WEEKLY").alias("freq"), (1 + F.col("p_partkey") % 3).cast("int").alias("interval_n"), (3 + F.col("p_size") % 9).cast("int").alias("count_n"), F.lit(None).cast("date").alias("until_day"), F.lit(None).cast("array<int>").alias("by_days"))
    return recurrence.rule_days(e, "2024-06-01")


@query("r8_occurrence_cleanup", """
WITH o AS (SELECT event_id, start_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE deadline END AS end_at, CASE WHEN event_id % 6 = 0 THEN event_id % 120 END AS minutes, all_day, event_id % 9 = 0 AS cancelled FROM v_cal_events),
f AS (SELECT event_id, start_at, all_day, cancelled, coalesce(end_at, start_at + to_minutes(CAST(minutes AS INT)), CASE WHEN all_day THEN start_at + INTERVAL 1 DAY ELSE start_at END) AS end_at FROM o),
g AS (SELECT event_id, start_at, cancelled, CASE WHEN end_at > start_at THEN end_at WHEN all_day THEN start_at + INTERVAL 1 DAY ELSE start_at + INTERVAL 30 MINUTE END AS end_at FROM f)
SELECT event_id, start_at, end_at, CASE WHEN cancelled THEN 'cancelled' WHEN end_at <= $NOW THEN 'past' WHEN start_at >= $NOW + INTERVAL 366 DAY THEN 'beyond' ELSE 'kept' END AS fate FROM g""")
def _(t):
    o = t.cal_events.select("event_id", "start_at", F.when(F.col("event_id") % 4 != 0, F.col("deadline")).alias("end_at"), F.when(F.col("event_id") % 6 == 0, F.col("event_id") % 120).cast("int").alias("minutes"), "all_day", (F.col("event_id") % 9 == 0).alias("cancelled"))
    return intervals_cleaned(o, "2024-01-15 12:00:00")


def intervals_cleaned(o: DataFrame, now: str) -> DataFrame:
    """Ends by the first of DTEND, DURATION, a day (all-day) or nothing; empty ones get a day or half an hour; then each row's fate."""
    later = lambda days, minutes: F.col("start_at") + F.make_dt_interval(F.lit(days), F.lit(0), minutes)
    end = F.coalesce("end_at", later(0, F.col("minutes")), F.when(F.col("all_day"), later(1, F.lit(0))).otherwise(F.col("start_at")))
    o = o.withColumn("end_at", end)
    o = o.withColumn("end_at", F.when(F.col("end_at") > F.col("start_at"), F.col("end_at")).when(F.col("all_day"), later(1, F.lit(0))).otherwise(later(0, F.lit(30))))
    at = intervals.ntz(now)
    fate = F.when(F.col("cancelled"), "cancelled").when(F.col("end_at") <= at, "past").when(F.col("start_at") >= at + F.expr("interval 366 days"), "beyond").otherwise("kept")
    return o.select("event_id", "start_at", "end_at", fate.alias("fate"))
