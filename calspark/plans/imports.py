"""Queries over slots, drafts and imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calspark.operators import intervals, slots

from .calendar import ENTRIES, entries
from .registry import query


@query("p10_slot_check", """
SELECT position, CASE WHEN occurrence_date IS NOT NULL THEN isodow(occurrence_date) - 1 ELSE weekday END AS weekday, CASE WHEN occurrence_date IS NOT NULL THEN 'every' ELSE week_pattern END AS week_pattern,
  CASE WHEN end_min <= start_min THEN 'end' WHEN confidence < 0.95 THEN 'confidence' END AS reason FROM v_slots""")
def _(t):
    return slots.dated(t.slots).select("position", "weekday", "week_pattern", slots.reject_reason(0.95).alias("reason"))


@query("p11_confidence", "SELECT position FROM v_slots WHERE confidence >= 0.95")
def _(t):
    return t.slots.filter(F.col("confidence") >= 0.95).select("position")


@query("p12_valid_range", "SELECT position FROM v_slots WHERE occurrence_date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def _(t):
    return t.slots.filter(F.col("occurrence_date").between("1995-01-01", "1995-06-30")).select("position")


@query("a8_import_span", """
SELECT draft_id, min(occurrence_date) AS first_day, max(occurrence_date) AS last_day, bool_and(occurrence_date IS NOT NULL) AS all_dated, bool_or(occurrence_date IS NULL) AS some_undated FROM v_slots GROUP BY draft_id""")
def _(t):
    there = F.col("occurrence_date").isNotNull()
    return t.slots.groupBy("draft_id").agg(F.min("occurrence_date").alias("first_day"), F.max("occurrence_date").alias("last_day"), F.bool_and(there).alias("all_dated"), F.bool_or(~there).alias("some_undated"))


@query("a10_weekday_coverage", """
WITH s AS (SELECT draft_id, count(DISTINCT weekday) AS n FROM v_slots GROUP BY draft_id), o AS (SELECT draft_id, count(DISTINCT weekday) AS k FROM v_slots WHERE confidence >= 0.97 GROUP BY draft_id)
SELECT s.draft_id, coalesce(k, 0) / CAST(n AS DOUBLE) AS ratio, n - coalesce(k, 0) AS n_missing, CASE WHEN n >= 4 THEN coalesce(k, 0) / CAST(n AS DOUBLE) >= 0.8 ELSE true END AS covered FROM s LEFT JOIN o ON o.draft_id = s.draft_id""")
def _(t):
    days = t.slots.groupBy("draft_id").agg(F.collect_set("weekday").alias("source"), F.collect_set(F.when(F.col("confidence") >= 0.97, F.col("weekday"))).alias("output"))
    n, k = F.size("source"), F.size(F.array_intersect("source", "output"))
    return days.select("draft_id", (k / n).alias("ratio"), F.size(F.array_except("source", "output")).cast("long").alias("n_missing"), F.when(n >= 4, k / n >= 0.8).otherwise(True).alias("covered"))


@query("a12_reject_counts", "SELECT CASE WHEN end_min <= start_min THEN 'end' WHEN confidence < 0.95 THEN 'confidence' END AS reason, count(*) AS n FROM v_slots GROUP BY 1")
def _(t):
    return t.slots.groupBy(slots.reject_reason(0.95).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("w1_latest_draft", "SELECT p_size AS account_id, max(p_partkey) AS draft_id FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_size")
def _(t):
    return slots.latest(t.part.filter("p_partkey % 3 <> 0").selectExpr("p_size AS account_id", "p_partkey AS draft_id"), "account_id", "draft_id")


@query("w4_dedup_first", "SELECT title, weekday, start_min, end_min, week_pattern, min(position) AS position FROM v_slots GROUP BY ALL")
def _(t):
    return slots.first_of_each(t.slots, slots.SIGNATURE, ["position"]).select(*slots.SIGNATURE, "position")


@query("w5_dedup_best", """
SELECT draft_id, weekday, start_min, position FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, weekday, start_min ORDER BY confidence DESC, position) AS rn FROM v_slots) WHERE rn = 1""")
def _(t):
    return slots.first_of_each(t.slots, ["draft_id", "weekday", "start_min"], [F.desc("confidence"), "position"]).select("draft_id", "weekday", "start_min", "position")


@query("l5_import_truncation", """
SELECT user_id, event_id, n > 50 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= 50""")
def _(t):
    w = Window.partitionBy("user_id")
    r = t.events.withColumns({"rn": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count(F.lit(1)).over(w)})
    return r.filter("rn <= 50").select("user_id", "event_id", (F.col("n") > 50).alias("truncated"))


@query("l7_undated_last", """
SELECT draft_id, position, row_number() OVER (PARTITION BY draft_id ORDER BY occurrence_date NULLS LAST, weekday, start_min, title, position) AS place FROM v_slots""")
def _(t):
    w = Window.partitionBy("draft_id").orderBy(F.asc_nulls_last("occurrence_date"), "weekday", "start_min", "title", "position")
    return t.slots.select("draft_id", "position", F.row_number().over(w).alias("place"))


@query("j11_active_keys", "SELECT o.o_custkey AS account_id, l.l_partkey AS uid_key FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' AND l.l_linenumber = 1")
def _(t):
    active = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id"))
    return t.lineitem.filter("l_linenumber = 1").join(active, "l_orderkey").select("account_id", F.col("l_partkey").alias("uid_key"))


@query("u6_new_keys", "SELECT DISTINCT l_partkey AS uid_key FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)")
def _(t):
    parsed = t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("uid_key")).distinct()
    return parsed.join(t.lineitem.filter("l_linenumber = 2").select(F.col("l_partkey").alias("uid_key")), "uid_key", "left_anti")


CONFIRM = """
batch AS (SELECT draft_id, title, weekday, start_min, end_min, week_pattern, min(position) AS position, draft_id % 75 AS account_id FROM v_slots GROUP BY ALL),
created AS (SELECT b.* FROM batch b WHERE NOT EXISTS (SELECT 1 FROM v_series s WHERE s.account_id = b.account_id AND s.title = b.title AND s.weekday = b.weekday AND s.start_min = b.start_min AND s.end_min = b.end_min AND s.week_pattern = b.week_pattern))"""


def created(t):
    return slots.confirmed(t.slots.withColumn("account_id", F.col("draft_id") % 75), t.series)


@query("d1_confirm_import", f"WITH {CONFIRM} SELECT position, 'schedule_import:' || CAST(draft_id AS VARCHAR) AS source FROM created")
def _(t):
    return created(t).select("position", "source")


@query("d1_confirm_states", f"""
WITH {CONFIRM}, n AS (SELECT draft_id, count(*) AS n FROM created GROUP BY draft_id) SELECT d.draft_id, CASE WHEN n.n IS NULL THEN 'imported' ELSE 'created' END AS state, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT draft_id FROM v_slots) d LEFT JOIN n ON n.draft_id = d.draft_id""")
def _(t):
    n = created(t).groupBy("draft_id").agg(F.count(F.lit(1)).alias("n"))
    return t.slots.select("draft_id").distinct().join(n, "draft_id", "left").select("draft_id", F.when(F.col("n").isNull(), "imported").otherwise("created").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query("d2_undo_import", "SELECT series_id FROM v_series WHERE source NOT IN ('schedule_import:3', 'schedule_import:5')")
def _(t):
    return slots.undone(t.series, t.series.filter(F.col("source").isin("schedule_import:3", "schedule_import:5")).select("source").distinct()).select("series_id")


@query("d3_supersede", "SELECT p_partkey AS draft_id, CASE WHEN p_partkey = max(p_partkey) OVER (PARTITION BY p_size) THEN 'ready' ELSE 'superseded' END AS status FROM part")
def _(t):
    last = F.max("p_partkey").over(Window.partitionBy("p_size"))
    return t.part.select(F.col("p_partkey").alias("draft_id"), F.when(F.col("p_partkey") == last, "ready").otherwise("superseded").alias("status"))


@query("d4_calendar_import", "SELECT DISTINCT e.event_id, e.start_at, e.deadline AS end_at, e.all_day FROM v_cal_events e WHERE e.event_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM v_event_timings k WHERE k.event_id = e.event_id AND k.event_id % 2 = 0)")
def _(t):
    known = t.event_timings.filter("event_id % 2 = 0").select("event_id")
    return t.cal_events.filter("event_id % 3 = 0").join(known, "event_id", "left_anti").select("event_id", "start_at", F.col("deadline").alias("end_at"), "all_day")


@query("d5_undo_calendar_import", """
SELECT 'event' AS part, count(*) AS n FROM v_cal_events WHERE event_id % 4 <> 1 UNION ALL SELECT 'timing', count(*) FROM v_event_timings WHERE event_id % 4 <> 1 UNION ALL SELECT 'reminder', count(*) FROM v_reminders WHERE event_id % 4 <> 1""")
def _(t):
    gone = t.cal_events.filter("event_id % 4 = 1").select("event_id")
    left = lambda df, part: df.join(gone, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return left(t.cal_events, "event").unionByName(left(t.event_timings, "timing")).unionByName(left(t.reminders, "reminder"))


@query("d7_checked_changes", f"""
WITH {ENTRIES}, c AS (SELECT event_id, subject, start_at + INTERVAL 2 HOUR AS start_at, end_at + INTERVAL 2 HOUR AS end_at, all_day FROM entries WHERE event_id % 10 = 3)
SELECT c.event_id, NOT EXISTS (SELECT 1 FROM entries e WHERE e.subject = c.subject AND e.event_id <> c.event_id AND NOT e.all_day AND NOT c.all_day AND e.start_at < c.end_at AND e.end_at > c.start_at) AS accepted FROM c""")
def _(t):
    e = entries(t)
    moved = e.filter("event_id % 10 = 3").withColumns({"start_at": F.expr("start_at + interval 2 hours"), "end_at": F.expr("end_at + interval 2 hours")})
    timed = lambda df: df.filter("NOT all_day").select("subject", "event_id", "start_at", "end_at")
    hit = intervals.bucketed_overlaps(timed(moved), timed(e), "subject").filter("a.event_id <> b.event_id").select(F.col("a.event_id").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    return moved.select("event_id").join(hit, "event_id", "left").select("event_id", F.col("hit").isNull().alias("accepted"))


@query("d8_toggle_and_delete", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NOT is_completed ELSE is_completed END AS is_completed FROM v_cal_events WHERE event_id % 7 <> 0")
def _(t):
    toggled, deleted = t.cal_events.filter("event_id % 5 = 0").select("event_id", F.lit(True).alias("toggle")), t.cal_events.filter("event_id % 7 = 0").select("event_id")
    return t.cal_events.join(toggled, "event_id", "left").join(deleted, "event_id", "left_anti").select("event_id", F.when(F.col("toggle"), ~F.col("is_completed")).otherwise(F.col("is_completed")).alias("is_completed"))


@query("d9_drafts_on_confirm", """
SELECT d.event_id, EXISTS (SELECT 1 FROM v_cal_events c WHERE c.status = 'confirmed' AND c.user_id = d.user_id AND c.start_at < d.deadline AND c.deadline > d.start_at) AS removed FROM v_cal_events d WHERE d.status = 'draft'""")
def _(t):
    rows = t.cal_events.select("user_id", "event_id", "start_at", F.col("deadline").alias("end_at"), "status")
    hit = intervals.bucketed_overlaps(rows.filter("status = 'draft'").drop("status"), rows.filter("status = 'confirmed'").drop("status"), "user_id").select(F.col("a.event_id").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    return rows.filter("status = 'draft'").select("event_id").join(hit, "event_id", "left").select("event_id", F.col("hit").isNotNull().alias("removed"))


@query("x2_retry_selection", """
SELECT inbox_key, event_id FROM (SELECT *, row_number() OVER (ORDER BY created_at, event_id) AS rn FROM v_inbox WHERE attempts < 5 AND (status IN ('pending', 'failed') OR (status = 'processing' AND created_at < $NOW - INTERVAL 5 MINUTE))) WHERE rn <= 20""")
def _(t):
    stale = (F.col("status") == "processing") & (F.col("created_at") < F.lit("2024-01-15 11:55:00").cast("timestamp_ntz"))
    return t.inbox.filter((F.col("attempts") < 5) & (F.col("status").isin("pending", "failed") | stale)).orderBy("created_at", "event_id").limit(20).select("inbox_key", "event_id")


@query("s6_size_guard", """
SELECT doc_id, CASE WHEN octet_length(encode(text)) > 15000 THEN 'bytes' WHEN length(text) > 12000 THEN 'chars' END AS reject_reason FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.when(F.octet_length("text") > 15000, "bytes").when(F.char_length("text") > 12000, "chars").alias("reject_reason"))
