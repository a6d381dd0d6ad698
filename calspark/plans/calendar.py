"""Queries over events and their intervals: filters, joins, orders, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.operators import identity, intervals
from calspark.operators.intervals import minutes_before, ntz, seconds

from .registry import NOW, query
from .views import Tables

ENTRIES = """
entries AS (
  SELECT e.event_id, e.user_id, e.platform, e.title, e.status, e.is_completed, e.deadline, e.created_at,
         coalesce(t.start_at, e.deadline - INTERVAL 30 MINUTE) AS start_at, coalesce(t.end_at, e.deadline) AS end_at, coalesce(t.all_day, false) AS all_day,
         coalesce('account:' || CAST(i.account_id AS VARCHAR), e.platform || ':' || CAST(u.external_id AS VARCHAR)) AS subject
  FROM v_cal_events e JOIN v_users u ON u.user_id = e.user_id LEFT JOIN v_event_timings t ON t.event_id = e.event_id
  LEFT JOIN v_identities i ON i.platform = u.platform AND i.external_id = u.external_id
  WHERE e.status = 'confirmed'
)"""


def entries(t: Tables) -> DataFrame:
    """Confirmed events of all subjects, with their intervals."""
    return identity.linked(intervals.with_interval(intervals.confirmed(t.cal_events), t.event_timings), t.users, t.identities)


@query("p1_confirmed", "SELECT event_id, user_id, title FROM v_cal_events WHERE status = 'confirmed'")
def _(t):
    return intervals.confirmed(t.cal_events).select("event_id", "user_id", "title")


@query("p2_past_upcoming", f"WITH {ENTRIES} SELECT event_id, end_at <= $NOW AS is_past, NOT is_completed AND start_at > $NOW AS is_upcoming FROM entries")
def _(t):
    return intervals.classified(entries(t), NOW).select("event_id", "is_past", "is_upcoming")


@query("p3_default_interval", f"WITH {ENTRIES} SELECT event_id, start_at, end_at, all_day FROM entries")
def _(t):
    return entries(t).select("event_id", "start_at", "end_at", "all_day")


@query("p4_zone_to_utc", "SELECT event_id, start_at - CASE WHEN user_id % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 7 HOUR END AS start_utc FROM v_cal_events")
def _(t):
    zone = F.when(F.col("user_id") % 2 == 0, F.lit("Etc/GMT-3")).otherwise(F.lit("Etc/GMT-7"))
    return t.cal_events.select("event_id", F.convert_timezone(zone, F.lit("UTC"), F.col("start_at")).alias("start_utc"))


@query("p5_reference_codec", """
SELECT event_id, CASE WHEN platform = 'a' THEN 't' ELSE 'm' END || ':' || CAST(event_id AS VARCHAR) AS ref,
       CASE WHEN platform = 'a' THEN 't' ELSE 'm' END AS kind, event_id AS number FROM v_cal_events""")
def _(t):
    ref = t.cal_events.select("event_id", F.concat_ws(":", F.when(F.col("platform") == "a", "t").otherwise("m"), F.col("event_id").cast("string")).alias("ref"))
    return ref.select("event_id", "ref", F.nullif(F.regexp_extract("ref", "^([tm]):[0-9]+$", 1), F.lit("")).alias("kind"), F.expr("try_cast(nullif(regexp_extract(ref, '^[tm]:([0-9]+)$', 1), '') AS bigint)").alias("number"))


@query("p6_open_work", "SELECT status, count(*) AS n FROM v_inbox WHERE status IN ('pending', 'processing') GROUP BY status")
def _(t):
    return t.inbox.filter(F.col("status").isin("pending", "processing")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("p7_open_deadlines", "SELECT event_id, deadline FROM v_cal_events WHERE status = 'confirmed' AND NOT is_completed AND deadline > $NOW")
def _(t):
    return intervals.confirmed(t.cal_events).filter(~F.col("is_completed") & (F.col("deadline") > ntz(NOW))).select("event_id", "deadline")


@query("p8_interval_check", """
SELECT event_id, CASE WHEN deadline <= start_at THEN 'end' WHEN NOT all_day AND deadline - start_at > INTERVAL 7 DAY THEN 'long'
  WHEN all_day AND deadline - start_at > INTERVAL 366 DAY THEN 'long' WHEN length(title) NOT BETWEEN 1 AND 255 THEN 'title' END AS reject_reason FROM v_cal_events""")
def _(t):
    length = seconds("deadline") - seconds("start_at")
    limit = F.when(F.col("all_day"), 366).otherwise(7) * 86400
    reason = F.when(length <= 0, "end").when(length > limit, "long").when(~F.length("title").between(1, 255), "title")
    return t.cal_events.select("event_id", reason.alias("reject_reason"))


@query("p9_date_only", """
SELECT l_orderkey, l_linenumber, length(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) = 10 AS all_day, CAST(l_shipdate AS DATE) AS first_day,
       CAST(CAST(l_shipdate AS DATE) + to_days(CAST(l_linenumber AS INT)) + INTERVAL 1 DAY AS DATE) AS end_day FROM lineitem""")
def _(t):
    text = F.to_date("l_shipdate").cast("string")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.length(text) == 10).alias("all_day"), F.to_date(text).alias("first_day"), F.date_add(F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")), 1).alias("end_day"))


@query("p13_partial_update", """
SELECT e.event_id, CASE WHEN e.event_id % 7 = 0 THEN upper(e.title) ELSE e.title END AS title,
       CASE WHEN e.event_id % 5 = 0 THEN e.deadline + INTERVAL 1 DAY ELSE e.deadline END AS deadline FROM v_cal_events e""")
def _(t):
    e = t.cal_events
    changes = e.filter("event_id % 7 = 0 OR event_id % 5 = 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.upper("title")).alias("new_title"), F.when(F.col("event_id") % 5 == 0, F.expr("deadline + interval 1 day")).alias("new_deadline"))
    return e.join(changes, "event_id", "left").select("event_id", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_deadline", "deadline").alias("deadline"))


@query("j1_event_user", "SELECT e.event_id, u.platform, u.external_id FROM v_cal_events e JOIN v_users u ON u.user_id = e.user_id")
def _(t):
    return t.cal_events.drop("platform").join(t.users.select("user_id", "platform", "external_id"), "user_id").select("event_id", "platform", "external_id")


@query("j2_event_timing", "SELECT e.event_id, t.end_at FROM v_cal_events e LEFT JOIN v_event_timings t ON t.event_id = e.event_id")
def _(t):
    return t.cal_events.select("event_id").join(t.event_timings.select("event_id", "end_at"), "event_id", "left")


@query("j3_backfill_timings", """
SELECT event_id, start_at, end_at, all_day FROM v_event_timings UNION ALL
SELECT e.event_id, e.deadline - INTERVAL 30 MINUTE, e.deadline, false FROM v_cal_events e WHERE NOT EXISTS (SELECT 1 FROM v_event_timings t WHERE t.event_id = e.event_id)""")
def _(t):
    missing = t.cal_events.join(t.event_timings, "event_id", "left_anti").select("event_id", minutes_before("deadline", 30).alias("start_at"), F.col("deadline").alias("end_at"), F.lit(False).alias("all_day"))
    return t.event_timings.select("event_id", "start_at", "end_at", "all_day").unionByName(missing)


@query("j4_event_reminders", """
SELECT e.event_id, count(r.reminder_id) AS n, min(r.remind_at) AS first_at, string_agg(CAST(r.reminder_id AS VARCHAR), ',' ORDER BY r.remind_at) AS ids
FROM v_cal_events e LEFT JOIN v_reminders r ON r.event_id = e.event_id AND r.status = 'pending' GROUP BY e.event_id""")
def _(t):
    own = t.reminders.filter("status = 'pending'").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("remind_at", "reminder_id"))).alias("r"))
    own = own.select("event_id", F.size("r").cast("long").alias("n"), F.col("r")[0]["remind_at"].alias("first_at"), F.array_join(F.transform("r", lambda x: x["reminder_id"].cast("string")), ",").alias("ids"))
    return t.cal_events.select("event_id").join(own, "event_id", "left").fillna(0, ["n"])


@query("j5_identity_resolution", """
SELECT u.user_id, i.account_id, coalesce('account:' || CAST(i.account_id AS VARCHAR), u.platform || ':' || CAST(u.external_id AS VARCHAR)) AS subject
FROM v_users u LEFT JOIN v_identities i ON i.platform = u.platform AND i.external_id = u.external_id""")
def _(t):
    return identity.resolved(t.users, t.identities).select("user_id", "account_id", "subject")


@query("j6_conflict_pairs", f"""
WITH {ENTRIES} SELECT a.subject, a.event_id AS event_a, b.event_id AS event_b, greatest(a.start_at, b.start_at) AS from_at, least(a.end_at, b.end_at) AS to_at
FROM entries a JOIN entries b ON a.subject = b.subject AND a.event_id < b.event_id AND a.start_at < b.end_at AND a.end_at > b.start_at
WHERE NOT a.all_day AND NOT b.all_day""")
def conflict_pairs(t):
    return intervals.conflicts(entries(t))


@query("j7_long_overlaps", f"""
WITH {ENTRIES} SELECT a.subject, a.event_id, b.event_id AS long_id FROM entries a
JOIN entries b ON a.subject = b.subject AND a.event_id <> b.event_id AND a.start_at < b.end_at AND a.end_at > b.start_at
WHERE b.all_day OR b.end_at - b.start_at >= INTERVAL 1 DAY""")
def _(t):
    return intervals.long_overlaps(entries(t))


@query("j8_deadline_band", """
SELECT a.user_id, a.event_id AS event_a, b.event_id AS event_b FROM v_cal_events a JOIN v_cal_events b ON a.user_id = b.user_id AND a.event_id < b.event_id
WHERE a.status = 'confirmed' AND b.status = 'confirmed' AND abs(epoch(a.deadline) - epoch(b.deadline)) < 3600""")
def _(t):
    return intervals.near_deadlines(t.cal_events)


@query("j13_preferences", """
SELECT DISTINCT i.account_id, coalesce(p.enabled, true) AS enabled, coalesce(p.frequency, 'minimal') AS frequency,
       coalesce(p.summary_hour, 8) AS summary_hour, coalesce(p.snooze_minutes, 30) AS snooze_minutes
FROM v_identities i LEFT JOIN v_preferences p ON p.account_id = i.account_id""")
def preferences(t):
    accounts = t.identities.select("account_id").distinct().join(t.preferences, "account_id", "left")
    return accounts.fillna({"enabled": True, "frequency": "minimal", "summary_hour": 8, "snooze_minutes": 30})


@query("l1_calendar_order", f"""
WITH {ENTRIES} SELECT subject, event_id, row_number() OVER (PARTITION BY subject ORDER BY start_at, event_id) AS place FROM entries""")
def _(t):
    return entries(t).select("subject", "event_id", F.row_number().over(Window.partitionBy("subject").orderBy("start_at", "event_id")).alias("place"))


@query("l2_next_twelve", f"""
WITH {ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_at, event_id) AS rn FROM entries WHERE NOT is_completed AND start_at > $NOW)
SELECT subject, event_id, start_at FROM n WHERE rn <= 12""")
def _(t):
    ranked = entries(t).filter(~F.col("is_completed") & (F.col("start_at") > ntz(NOW))).withColumn("rn", F.row_number().over(Window.partitionBy("subject").orderBy("start_at", "event_id")))
    return ranked.filter("rn <= 12").select("subject", "event_id", "start_at")


@query("u1_both_platforms", "SELECT platform, count(*) AS n FROM v_cal_events GROUP BY platform")
def _(t):
    e = t.cal_events.select("event_id", "platform")
    return e.filter("platform = 'a'").unionByName(e.filter("platform = 'b'")).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("u4_distinct_instants", "SELECT event_id // 2 AS pair_id, count(DISTINCT remind_at) AS n FROM v_reminders GROUP BY 1")
def _(t):
    return t.reminders.selectExpr("event_id div 2 AS pair_id", "remind_at").distinct().groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))


@query("u7_run_diff", """
SELECT title, weekday, 'a' AS only_in FROM (SELECT title, weekday FROM v_slots WHERE week_pattern = 'odd' EXCEPT ALL SELECT title, weekday FROM v_slots WHERE week_pattern = 'even')
UNION ALL SELECT title, weekday, 'b' FROM (SELECT title, weekday FROM v_slots WHERE week_pattern = 'even' EXCEPT ALL SELECT title, weekday FROM v_slots WHERE week_pattern = 'odd')""")
def _(t):
    a, b = (t.slots.filter(F.col("week_pattern") == x).select("title", "weekday") for x in ("odd", "even"))
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


@query("w6_lanes")
def _(t):
    return intervals.lanes(entries(t))


@query("w6_lane_count", f"""
WITH {ENTRIES}, s AS (SELECT subject, CAST(start_at AS DATE) AS day, start_at AS tm, 1 AS step FROM entries WHERE NOT all_day
  UNION ALL SELECT subject, CAST(start_at AS DATE), end_at, -1 FROM entries WHERE NOT all_day),
r AS (SELECT subject, day, sum(step) OVER (PARTITION BY subject, day ORDER BY tm, step ROWS UNBOUNDED PRECEDING) AS running FROM s)
SELECT subject, day, max(running) AS n_lanes FROM r GROUP BY subject, day""")
def _(t):
    """The greedy lanes of a day are as many as its peak."""
    return intervals.lanes(entries(t)).groupBy("subject", "day").agg((F.max("lane") + 1).cast("long").alias("n_lanes"))


@query("w7_peak_concurrency", f"""
WITH {ENTRIES}, s AS (SELECT subject, CAST(start_at AS DATE) AS day, start_at AS tm, 1 AS step FROM entries WHERE NOT all_day
  UNION ALL SELECT subject, CAST(start_at AS DATE), end_at, -1 FROM entries WHERE NOT all_day),
r AS (SELECT subject, day, sum(step) OVER (PARTITION BY subject, day ORDER BY tm, step ROWS UNBOUNDED PRECEDING) AS running FROM s)
SELECT subject, day, max(running) AS peak FROM r GROUP BY subject, day""")
def _(t):
    return intervals.peak_concurrency(entries(t))


@query("w10_first_identity", "SELECT account_id, arg_min(platform, external_id) AS platform, min(external_id) AS external_id FROM v_identities GROUP BY account_id")
def _(t):
    return identity.first_identity(t.identities)


@query("w10_preferred_identity", """
SELECT account_id, platform, external_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY platform <> 'b', external_id) AS rn FROM v_identities) WHERE rn = 1""")
def _(t):
    """The identity on platform b, where there is one."""
    return identity.first_identity(t.identities, "b")


@query("s10_calendar_json", f"""
WITH {ENTRIES} SELECT event_id, '{{"id":"' || CASE WHEN platform = 'a' THEN 't:' ELSE 'm:' END || CAST(event_id AS VARCHAR) || '","title":"' || title || '","start":"' || strftime(start_at, '%Y-%m-%dT%H:%M:%S') ||
  '","end":"' || strftime(end_at, '%Y-%m-%dT%H:%M:%S') || '","all_day":' || CAST(all_day AS VARCHAR) || ',"is_completed":' || CAST(is_completed AS VARCHAR) || '}}' AS payload FROM entries""")
def _(t):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ref = F.concat_ws(":", F.when(F.col("platform") == "a", "t").otherwise("m"), F.col("event_id").cast("string"))
    return entries(t).select("event_id", F.to_json(F.struct(ref.alias("id"), "title", iso("start_at").alias("start"), iso("end_at").alias("end"), "all_day", "is_completed")).alias("payload"))


@query("s7_table_scan", "SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("s11_tabular_rows", """
SELECT strftime(created_at, '%Y-%m-%d %H:%M') AS added_at, title, strftime(deadline, '%d.%m.%Y %H:%M') AS deadline, 'active' AS state FROM v_cal_events WHERE status = 'confirmed'""")
def _(t):
    return intervals.confirmed(t.cal_events).select(F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("added_at"), "title", F.date_format("deadline", "dd.MM.yyyy HH:mm").alias("deadline"), F.lit("active").alias("state"))


@query("s12_outbound_diff", """
WITH old AS (SELECT sha256('event:' || CAST(event_id AS VARCHAR)) AS uid, title, deadline FROM v_cal_events WHERE event_id % 3 <> 0),
new AS (SELECT sha256('event:' || CAST(event_id AS VARCHAR)) AS uid, CASE WHEN event_id % 5 = 0 THEN upper(title) ELSE title END AS title, deadline FROM v_cal_events WHERE event_id % 4 <> 0)
SELECT coalesce(o.uid, n.uid) AS uid, CASE WHEN o.uid IS NULL THEN 'insert' WHEN n.uid IS NULL THEN 'delete' ELSE 'update' END AS op
FROM old o FULL JOIN new n ON o.uid = n.uid WHERE o.uid IS NULL OR n.uid IS NULL OR o.title <> n.title OR o.deadline <> n.deadline""")
def _(t):
    uid = F.sha2(F.concat(F.lit("event:"), F.col("event_id").cast("string")), 256)
    old = t.cal_events.filter("event_id % 3 <> 0").select(uid.alias("uid"), F.struct("title", "deadline").alias("old"))
    new = t.cal_events.filter("event_id % 4 <> 0").select(uid.alias("uid"), F.struct(F.when(F.col("event_id") % 5 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), "deadline").alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return old.join(new, "uid", "full_outer").select("uid", op.alias("op")).filter("op IS NOT NULL")
