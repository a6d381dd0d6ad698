"""Queries over reminders, summaries and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from calspark.operators import intervals, reminders, summaries
from calspark.operators.intervals import ntz

from .calendar import ENTRIES, entries
from .registry import NOW, query

OFFSETS = "(VALUES (1440), (720), (60), (30), (15)) o(m)"
VALID = """
valid AS (SELECT event_id, remind_at, row_number() OVER (PARTITION BY event_id ORDER BY remind_at) AS rn FROM
  (SELECT DISTINCT event_id, date_trunc('minute', remind_at) AS remind_at FROM times WHERE remind_at > $NOW AND remind_at < start_at))"""
TIMES = f"times AS (SELECT event_id, start_at, CAST(start_at - to_minutes(CAST(m AS INT)) AS TIMESTAMP) AS remind_at FROM entries CROSS JOIN {OFFSETS})"


@query("m1_standard_reminders", f"WITH {ENTRIES}, {TIMES} SELECT event_id, remind_at FROM times")
def _(t):
    return reminders.standard(entries(t)).select("event_id", "remind_at")


@query("m2_legacy_reminders", f"""
WITH e AS (SELECT event_id, deadline FROM v_cal_events WHERE status = 'confirmed')
SELECT event_id, CAST(deadline - to_minutes(CAST(m AS INT)) AS TIMESTAMP) AS remind_at FROM e CROSS JOIN {OFFSETS} WHERE deadline - to_minutes(CAST(m AS INT)) > $NOW
UNION ALL SELECT event_id, $NOW FROM e WHERE deadline > $NOW AND deadline < $NOW + INTERVAL 24 HOUR""")
def _(t):
    return reminders.legacy(intervals.confirmed(t.cal_events), NOW).select("event_id", "remind_at")


@query("m3_contextual_reminders", f"""
WITH {ENTRIES}, k AS (SELECT *, date_trunc('day', start_at) - INTERVAL 4 HOUR AS evening FROM entries)
SELECT event_id, unnest(CASE WHEN lower(title) LIKE '%purchase%' THEN [start_at - INTERVAL 2880 MINUTE, start_at - INTERVAL 1440 MINUTE, evening, start_at - INTERVAL 180 MINUTE]
  WHEN lower(title) LIKE '%signup%' THEN [start_at - INTERVAL 1440 MINUTE, evening, start_at - INTERVAL 360 MINUTE]
  WHEN hour(start_at) <= 10 THEN [evening, start_at - INTERVAL 60 MINUTE] ELSE [start_at - INTERVAL 180 MINUTE, start_at - INTERVAL 60 MINUTE] END) AS remind_at FROM k""")
def _(t):
    return reminders.contextual(entries(t), "purchase", "signup").select("event_id", "remind_at")


@query("m4_all_day_reminder", f"""
WITH {ENTRIES} SELECT event_id, CASE WHEN date_trunc('day', start_at) - INTERVAL 5 HOUR > $NOW THEN date_trunc('day', start_at) - INTERVAL 5 HOUR ELSE date_trunc('day', start_at) + INTERVAL 9 HOUR END AS remind_at
FROM entries WHERE all_day""")
def _(t):
    return reminders.all_day(entries(t).filter("all_day"), NOW).select("event_id", "remind_at")


@query("m5_valid_times", f"WITH {ENTRIES}, {TIMES}, {VALID} SELECT event_id, remind_at FROM valid WHERE rn <= 4")
def _(t):
    return reminders.valid(reminders.standard(entries(t)), NOW)


@query("m6_frequency_cap", f"""
WITH {ENTRIES}, {TIMES}, {VALID}, p AS (SELECT v.event_id, v.remind_at, p.frequency, row_number() OVER (PARTITION BY v.event_id ORDER BY v.remind_at DESC) AS place
  FROM valid v JOIN v_cal_events e ON e.event_id = v.event_id JOIN v_preferences p ON p.account_id = e.user_id // 2 WHERE v.rn <= 4 AND p.enabled)
SELECT event_id, remind_at FROM p WHERE place <= CASE frequency WHEN 'minimal' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END""")
def _(t):
    e = entries(t)
    rows = reminders.valid(reminders.standard(e), NOW).join(e.selectExpr("event_id", "user_id div 2 AS account_id"), "event_id")
    return reminders.capped(rows, t.preferences).select("event_id", "remind_at")


@query("m7_alarms_or_rules", f"""
WITH {ENTRIES}, alarms AS (SELECT event_id, min(remind_at) AS alarm FROM v_reminders WHERE event_id % 3 = 0 GROUP BY event_id)
SELECT e.event_id, coalesce(a.alarm, e.start_at - INTERVAL 60 MINUTE) AS remind_at FROM entries e LEFT JOIN alarms a ON a.event_id = e.event_id
WHERE coalesce(a.alarm, e.start_at - INTERVAL 60 MINUTE) < CASE WHEN e.all_day THEN e.end_at ELSE e.start_at END""")
def _(t):
    alarms = t.reminders.filter("event_id % 3 = 0").groupBy("event_id").agg(F.min("remind_at").alias("alarm"))
    rows = entries(t).join(alarms, "event_id", "left").withColumn("remind_at", F.coalesce("alarm", reminders.before("start_at", 60)))
    return rows.filter(F.col("remind_at") < F.when(F.col("all_day"), F.col("end_at")).otherwise(F.col("start_at"))).select("event_id", "remind_at")


DECIDED = """
decided AS (SELECT r.reminder_id, r.event_id, e.is_completed OR e.start_at <= $NOW AS over, r.event_id % 11 = 0 AS waits,
  row_number() OVER (PARTITION BY r.event_id ORDER BY r.remind_at, r.reminder_id) AS rn
  FROM v_reminders r JOIN v_cal_events e ON e.event_id = r.event_id
  WHERE r.status = 'pending' AND ((e.is_completed OR e.start_at <= $NOW) OR (r.remind_at <= $NOW AND e.status = 'confirmed')))"""


def decisions(t):
    return reminders.decided(t.reminders, t.cal_events, t.cal_events.filter("event_id % 11 = 0"), NOW)


@query("m8_expired", f"WITH {DECIDED} SELECT reminder_id FROM decided WHERE over")
def _(t):
    return decisions(t).filter("decision = 'expire'").select("reminder_id")


@query("m9_due", """
SELECT r.reminder_id, r.event_id FROM v_reminders r JOIN v_cal_events e ON e.event_id = r.event_id
WHERE r.status = 'pending' AND r.remind_at <= $NOW AND NOT e.is_completed AND e.status = 'confirmed' AND e.start_at > $NOW""")
def _(t):
    e = intervals.confirmed(t.cal_events).filter(~F.col("is_completed") & (F.col("start_at") > ntz(NOW))).select("event_id")
    return t.reminders.filter((F.col("status") == "pending") & (F.col("remind_at") <= ntz(NOW))).join(e, "event_id").select("reminder_id", "event_id")


@query("m10_delivery_decision", f"""
WITH {DECIDED} SELECT reminder_id, event_id, CASE WHEN over THEN 'expire' WHEN waits THEN 'blocked' WHEN rn = 1 THEN 'send' ELSE 'blocked' END AS decision FROM decided""")
def _(t):
    return decisions(t).select("reminder_id", "event_id", "decision")


@query("m11_acknowledge", """
SELECT reminder_id, CASE WHEN event_id % 4 = 0 AND status = 'pending' AND remind_at <= $NOW THEN 'sent' ELSE status END AS status FROM v_reminders""")
def _(t):
    return reminders.acknowledged(t.reminders, t.cal_events.filter("event_id % 4 = 0"), NOW).select("reminder_id", "status")


@query("m12_snooze", """
WITH s AS (SELECT event_id, $NOW + to_minutes(CAST(15 * (1 + event_id % 4) AS INT)) AS new_at, start_at FROM v_cal_events WHERE event_id % 3 = 0),
ok AS (SELECT * FROM s WHERE new_at < start_at)
SELECT r.event_id, r.remind_at, r.status FROM v_reminders r WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.event_id = r.event_id AND r.status = 'pending' AND r.remind_at <= ok.new_at)
UNION ALL SELECT event_id, new_at, 'pending' FROM ok""")
def _(t):
    s = t.cal_events.filter("event_id % 3 = 0").select("event_id", (15 * (1 + F.col("event_id") % 4)).cast("int").alias("minutes"), "start_at")
    return reminders.snoozed(t.reminders, s, NOW)


@query("m13_replace_reminders", f"""
WITH {ENTRIES}, wanted AS (SELECT DISTINCT e.event_id, date_trunc('hour', r.remind_at) AS remind_at FROM v_reminders r JOIN entries e ON e.event_id = r.event_id
  WHERE e.event_id % 2 = 0 AND date_trunc('hour', r.remind_at) < CASE WHEN e.all_day THEN e.end_at ELSE e.start_at END)
SELECT event_id, remind_at FROM wanted UNION ALL SELECT r.event_id, r.remind_at FROM v_reminders r WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.event_id = r.event_id)""")
def _(t):
    e = entries(t).filter("event_id % 2 = 0").select("event_id", F.when(F.col("all_day"), F.col("end_at")).otherwise(F.col("start_at")).alias("limit_at"))
    wanted = t.reminders.join(e, "event_id").select("event_id", F.date_trunc("hour", "remind_at").cast("timestamp_ntz").alias("remind_at"), "limit_at")
    wanted = wanted.filter("remind_at < limit_at").select("event_id", "remind_at").distinct()
    return wanted.unionByName(t.reminders.join(wanted, "event_id", "left_anti").select("event_id", "remind_at"))


@query("m14_summary_due", """
SELECT p.account_id, summary_hour FROM v_preferences p WHERE enabled AND hour($NOW + to_hours(CAST(account_id % 12 AS INT))) >= summary_hour AND account_id % 6 <> 0""")
def _(t):
    local = ntz(NOW) + F.make_dt_interval(F.lit(0), (F.col("account_id") % 12).cast("int"))
    return t.preferences.filter(F.col("enabled") & (F.hour(local) >= F.col("summary_hour")) & (F.col("account_id") % 6 != 0)).select("account_id", "summary_hour")


@query("w11_first_due", f"WITH {DECIDED} SELECT reminder_id FROM decided WHERE NOT over AND NOT waits AND rn = 1")
def _(t):
    return decisions(t).filter("decision = 'send'").select("reminder_id")


PLAN = """
plan AS (SELECT e.*, CAST(d AS DATE) AS day FROM entries e, unnest(CASE WHEN all_day THEN generate_series(date_trunc('day', start_at), greatest(end_at - INTERVAL 1 SECOND, start_at), INTERVAL 1 DAY) ELSE [date_trunc('day', start_at)] END) u(d)
  WHERE NOT is_completed AND end_at > $NOW AND CAST(d AS DATE) >= DATE '2024-01-15' AND CAST(d AS DATE) < DATE '2024-01-22')"""


def plan(t):
    return summaries.plan_rows(entries(t), "2024-01-15", 7, NOW)


@query("y1_plan_rows", f"WITH {ENTRIES}, {PLAN} SELECT subject, day, event_id FROM plan")
def _(t):
    return plan(t).select("subject", "day", "event_id")


@query("y2_running_now", f"WITH {ENTRIES}, {PLAN} SELECT event_id, day, start_at <= $NOW AND $NOW < end_at AS running FROM plan")
def _(t):
    return plan(t).select("event_id", "day", ((F.col("start_at") <= ntz(NOW)) & (ntz(NOW) < F.col("end_at"))).alias("running"))


@query("y3_day_overlaps", f"""
WITH {ENTRIES}, {PLAN} SELECT a.subject, a.day, a.event_id AS event_a, b.event_id AS event_b FROM plan a JOIN plan b ON a.subject = b.subject AND a.day = b.day AND a.event_id < b.event_id
AND a.start_at < b.end_at AND a.end_at > b.start_at WHERE NOT a.all_day AND NOT b.all_day""")
def _(t):
    return summaries.day_overlaps(plan(t))


@query("y4_free_days", f"""
WITH {ENTRIES}, {PLAN}, s AS (SELECT DISTINCT subject FROM entries), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-21', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.subject, d.day FROM s CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.subject = s.subject AND p.day = d.day)""")
def _(t):
    return summaries.free_days(plan(t), entries(t).select("subject").distinct(), "2024-01-15", 7)


@query("y5_day_digest", f"""
WITH {ENTRIES}, {PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY all_day DESC, start_at, event_id) AS place, CASE WHEN all_day THEN 'all day' ELSE strftime(start_at, '%H:%M') END || ' ' || title AS line FROM plan)
SELECT subject, day, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE place <= 6) AS text, greatest(count(*) - 6, 0) AS n_more FROM r GROUP BY subject, day""")
def _(t):
    return summaries.digest(plan(t), 6)


@query("a7_week_totals", f"""
WITH {ENTRIES}, {PLAN} SELECT subject, count(DISTINCT (start_at, end_at, title)) AS n_events, CAST(sum(CAST(all_day AS INT)) AS BIGINT) AS n_all_day FROM plan GROUP BY subject""")
def _(t):
    return summaries.week_totals(plan(t))


@query("a15_agenda_by_day", f"""
WITH {ENTRIES} SELECT subject, CAST(start_at AS DATE) AS day, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY start_at, event_id) AS ids FROM entries GROUP BY ALL""")
def _(t):
    rows = entries(t).groupBy("subject", F.to_date("start_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("start_at", "event_id"))).alias("x"))
    return rows.select("subject", "day", "n", F.array_join(F.transform("x", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("l4_day_caps", f"""
WITH {ENTRIES}, {PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY start_at, event_id) AS rn, count(*) OVER (PARTITION BY subject, day) AS n FROM plan)
SELECT subject, day, event_id, greatest(n - 3, 0) AS n_more FROM r WHERE rn <= 3""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("subject", "day")
    r = plan(t).withColumns({"rn": F.row_number().over(w.orderBy("start_at", "event_id")), "n": F.count(F.lit(1)).over(w)})
    return r.filter("rn <= 3").select("subject", "day", "event_id", F.greatest(F.col("n") - 3, F.lit(0)).alias("n_more"))


HISTORY = """
imports AS (SELECT account_id, source AS ref, min(valid_from) AS first_day, max(valid_until) AS last_day, count(*) AS n FROM v_series GROUP BY account_id, source),
history AS (SELECT account_id, 'imp:' || ref AS ref, CAST(first_day AS TIMESTAMP) AS created_at, n FROM imports
  UNION ALL SELECT user_id AS account_id, 'ev:' || CAST(event_id AS VARCHAR), created_at, 1 FROM v_cal_events e WHERE status = 'confirmed' AND event_id % 9 <> 0)"""


def history(t):
    """Imports and single events; events that an import made are hidden."""
    imports = t.series.groupBy("account_id", "source").agg(F.min("valid_from").alias("d"), F.count(F.lit(1)).alias("n"))
    imports = imports.select("account_id", F.concat(F.lit("imp:"), "source").alias("ref"), F.col("d").cast("timestamp_ntz").alias("created_at"), "n")
    imported = t.cal_events.filter("event_id % 9 = 0").select("event_id")
    single = intervals.confirmed(t.cal_events).join(imported, "event_id", "left_anti")
    return imports.unionByName(single.select(F.col("user_id").alias("account_id"), F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("ref"), "created_at", F.lit(1).cast("long").alias("n")))


@query("j12_history_antijoin", "SELECT event_id FROM v_cal_events WHERE status = 'confirmed' AND event_id % 9 <> 0")
def _(t):
    return intervals.confirmed(t.cal_events).join(t.cal_events.filter("event_id % 9 = 0"), "event_id", "left_anti").select("event_id")


@query("u3_history_union", f"WITH {HISTORY} SELECT account_id, ref, created_at, n FROM history")
def _(t):
    return history(t)


@query("l3_history_page", f"""
WITH {HISTORY}, r AS (SELECT *, row_number() OVER w AS place, lead(ref) OVER w IS NOT NULL AS more FROM history WINDOW w AS (PARTITION BY account_id ORDER BY created_at DESC, ref))
SELECT account_id, ref, place, more FROM r WHERE place > 8 AND place <= 16""")
def _(t):
    return summaries.page(history(t), "account_id", 8, 1).select("account_id", "ref", "place", "more")


@query("y6_import_preview", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY weekday, start_min, title, position) AS place, count(*) OVER (PARTITION BY draft_id) AS n FROM v_slots)
SELECT draft_id, string_agg(printf('%d %02d:%02d %s', weekday, start_min // 60, start_min % 60, title), chr(10) ORDER BY place) FILTER (WHERE place <= 12) AS lines, greatest(max(n) - 12, 0) AS n_more FROM r GROUP BY draft_id""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("draft_id")
    line = F.format_string("%d %02d:%02d %s", "weekday", F.expr("CAST(start_min div 60 AS INT)"), F.expr("start_min % 60"), "title")
    r = t.slots.withColumns({"place": F.row_number().over(w.orderBy("weekday", "start_min", "title", "position")), "line": line})
    g = r.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.when(F.col("place") <= 12, F.struct("place", "line")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return g.select("draft_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("lines"), F.greatest(F.col("n") - 12, F.lit(0)).alias("n_more"))


@query("y7_history_text", """
SELECT source, count(*) AS n, strftime(min(valid_from), '%d.%m.%Y') || '-' || strftime(max(valid_until), '%d.%m.%Y') AS period, max(valid_until) >= DATE '2024-01-15' AS deletable FROM v_series GROUP BY source""")
def _(t):
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    return t.series.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", day(F.min("valid_from")), day(F.max("valid_until"))).alias("period"), (F.max("valid_until") >= F.lit("2024-01-15").cast("date")).alias("deletable"))
