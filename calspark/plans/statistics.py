"""Queries over users, activity and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from calspark.operators import identity, product

from .registry import query


@query("a1_series_per_source", "SELECT source, count(*) AS n FROM v_series GROUP BY source")
def _(t):
    return t.series.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a2_items_per_import", "SELECT draft_id, count(*) AS n FROM v_slots GROUP BY draft_id")
def _(t):
    return t.slots.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n"))


@query("a3_distinct_subjects", """
WITH s AS (SELECT coalesce('account:' || CAST(i.account_id AS VARCHAR), u.platform || ':' || CAST(u.external_id AS VARCHAR)) AS subject, e.event_id
  FROM v_cal_events e JOIN v_users u ON u.user_id = e.user_id LEFT JOIN v_identities i ON i.platform = u.platform AND i.external_id = u.external_id)
SELECT count(DISTINCT subject) AS subjects, count(*) AS activity FROM s""")
def _(t):
    return identity.linked(t.cal_events, t.users, t.identities).agg(F.countDistinct("subject").alias("subjects"), F.count(F.lit(1)).alias("activity"))


@query("a4_first_seen", """
WITH u AS (SELECT coalesce('account:' || CAST(i.account_id AS VARCHAR), u.platform || ':' || CAST(u.external_id AS VARCHAR)) AS subject, u.created_at, i.created_at AS linked_at
  FROM v_users u LEFT JOIN v_identities i ON i.platform = u.platform AND i.external_id = u.external_id)
SELECT subject, min(least(created_at, coalesce(linked_at, created_at))) AS registered_at FROM u GROUP BY subject""")
def _(t):
    users = identity.resolved(t.users, t.identities).select("subject", F.col("created_at").alias("seen_at"))
    links = t.identities.select(F.concat(F.lit("account:"), F.col("account_id").cast("string")).alias("subject"), F.col("created_at").alias("seen_at"))
    return product.first_seen(users, links)


COHORT = """
r AS (SELECT subject_id AS subject, min(CAST(registered_at AS TIMESTAMP)) AS registered_at FROM v_subject_users GROUP BY subject_id),
c AS (SELECT r.subject, max(coalesce(a.active_at >= r.registered_at + INTERVAL 14 DAY AND a.active_at < r.registered_at + INTERVAL 21 DAY, false)) AS retained
  FROM r LEFT JOIN v_activity a ON a.subject_id = r.subject
  WHERE r.registered_at > TIMESTAMP '1995-04-01' AND r.registered_at + INTERVAL 21 DAY <= TIMESTAMP '1998-12-01' GROUP BY r.subject)"""


def cohort(t):
    registered = product.first_seen(t.subject_users.select(F.col("subject_id").alias("subject"), F.col("registered_at").cast("timestamp_ntz").alias("seen_at")))
    activity = t.activity.select(F.col("subject_id").alias("subject"), F.col("active_at").cast("timestamp_ntz").alias("active_at"))
    return product.week_three(registered, activity, "1995-04-01 00:00:00", "1998-12-01 00:00:00")


@query("a5_week_three_cohort", f"WITH {COHORT} SELECT subject, retained FROM c")
def _(t):
    return cohort(t)


@query("a5_retention", f"WITH {COHORT} SELECT count(*) AS cohort, CAST(sum(CAST(retained AS INT)) AS BIGINT) AS retained, round((527 * 35.0 / 100 + sum(CAST(retained AS INT))) / (527 + count(*)) * 100, 1) AS percent FROM c")
def _(t):
    return product.blended(cohort(t), 527, 35.0)


@query("a6_growth", "SELECT 7451 + greatest(count(*) - 100, 0) AS total FROM events")
def _(t):
    return product.grown(7451, t.events.agg(F.count(F.lit(1)).alias("n")), "n", 100)


@query("a11_mean_confidence", "SELECT draft_id, round(avg(coalesce(CASE WHEN weekday <> 3 THEN confidence END, 0.7)), 6) AS confidence FROM v_slots GROUP BY draft_id")
def _(t):
    return t.slots.groupBy("draft_id").agg(F.round(F.avg(F.coalesce(F.when(F.col("weekday") != 3, F.col("confidence")), F.lit(0.7))), 6).alias("confidence"))


@query("a13_merged_calendars", """
SELECT event_type AS kind, min(CASE WHEN user_id % 3 = 0 THEN user_id END) AS first_name, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, bool_or(event_id % 97 = 0) AS truncated FROM events GROUP BY event_type""")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.min(F.when(F.col("user_id") % 3 == 0, F.col("user_id"))).alias("first_name"), F.sum(F.floor("value")).alias("total"), F.bool_or(F.col("event_id") % 97 == 0).alias("truncated"))


@query("a16_import_counters", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'purchase') AS duplicates, count(*) FILTER (WHERE ts < $NOW) AS skipped_past, count(*) > 1000 AS truncated FROM events GROUP BY user_id""")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("created"), F.count_if(F.col("event_type") == "purchase").alias("duplicates"), F.count_if(F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("skipped_past"), (F.count(F.lit(1)) > 1000).alias("truncated"))


@query("d6_account_merge", """
SELECT s.series_id, coalesce(CASE WHEN account_id % 4 = 0 THEN account_id + 1 END, account_id) AS account_id FROM v_series s""")
def _(t):
    moves = t.series.select("account_id").distinct().filter("account_id % 4 = 0").withColumn("new_account_id", F.col("account_id") + 1)
    return identity.merged(t.series, moves).select("series_id", "account_id")


#: Each user as an account of its own, and requests of three users of four: into the next, into one of the same platform, into itself.
MERGES = """i AS (SELECT user_id AS account_id, platform FROM v_users),
  r AS (SELECT account_id, account_id + CASE account_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS new_account_id FROM i WHERE account_id % 4 < 3),
  m AS (SELECT *, CASE WHEN r.account_id = r.new_account_id THEN 'same' WHEN EXISTS (SELECT 1 FROM i a JOIN i b ON a.platform = b.platform WHERE a.account_id = r.account_id AND b.account_id = r.new_account_id) THEN 'platform' END AS reject FROM r)"""


def merge_requests(t):
    own = t.users.select(F.col("user_id").alias("account_id"), "platform")
    into = F.col("account_id") + F.when(F.col("account_id") % 4 == 0, 1).when(F.col("account_id") % 4 == 1, 2).otherwise(0)
    return identity.judged_moves(own.filter("account_id % 4 < 3").select("account_id", into.alias("new_account_id")), own)


@query("d6_merge_requests", f"WITH {MERGES} SELECT account_id, new_account_id, reject FROM m")
def _(t):
    return merge_requests(t)


@query("d6_merged_preferences", f"""
WITH {MERGES}, p AS (SELECT user_id AS account_id, user_id % 5 AS summary_hour FROM v_users WHERE user_id % 3 <> 0)
SELECT * FROM p UNION ALL SELECT new_account_id, summary_hour FROM m JOIN p USING (account_id) WHERE reject IS NULL AND new_account_id NOT IN (SELECT account_id FROM p)""")
def _(t):
    preferences = t.users.filter("user_id % 3 <> 0").select(F.col("user_id").alias("account_id"), (F.col("user_id") % 5).alias("summary_hour"))
    return identity.merged_preferences(preferences, merge_requests(t).filter("reject IS NULL").select("account_id", "new_account_id"))


#: Fours of users in a row, with three requests each: 0 into 1, 2 into 1, 1 into 3; every third four asks in the other order, and in every
#: other third account 1 has no identity.
FOURS = "q AS (SELECT user_id // 4 AS g FROM v_users GROUP BY 1 HAVING count(*) = 4), s AS (SELECT g, CAST(unnest(range(0, 3)) AS INTEGER) AS i FROM q), r AS (SELECT 3 * g + CASE WHEN g % 3 = 1 THEN 2 - i ELSE i END AS request_no, g, i, 4 * g + [0, 2, 1][i + 1] AS account_id, 4 * g + [1, 1, 3][i + 1] AS new_account_id FROM s)"


def sequences(t):
    fours = t.users.groupBy(F.expr("user_id div 4").alias("g")).agg(F.count(F.lit(1)).alias("n")).filter("n = 4").select("g", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    pick = lambda *x: 4 * F.col("g") + F.element_at(F.array(*map(F.lit, x)), F.col("i") + 1)
    requests = fours.select((3 * F.col("g") + F.when(F.col("g") % 3 == 1, 2 - F.col("i")).otherwise(F.col("i"))).alias("request_no"), pick(0, 2, 1).alias("account_id"), pick(1, 1, 3).alias("new_account_id"))
    own = t.users.filter("NOT (user_id div 4 % 3 = 0 AND user_id % 4 = 1)").select(F.col("user_id").alias("account_id"), "platform")
    return identity.merged_in_order(requests, own)


@query("d6_merge_sequence", f"""
WITH {FOURS} SELECT request_no, account_id, new_account_id, CASE WHEN g % 3 = 0 THEN CASE i WHEN 1 THEN 'platform' END WHEN g % 3 = 1 THEN CASE i WHEN 1 THEN NULL ELSE 'platform' END ELSE CASE i WHEN 0 THEN NULL ELSE 'platform' END END AS reject FROM r""")
def _(t):
    return sequences(t)[0]


@query("d6_merged_accounts", f"""
WITH {FOURS} SELECT 4 * g + k AS account_id, 4 * g + CASE WHEN g % 3 = 0 THEN CASE k WHEN 2 THEN 2 ELSE 3 END WHEN g % 3 = 1 THEN CASE k WHEN 2 THEN 1 ELSE k END ELSE CASE k WHEN 0 THEN 1 ELSE k END END AS root FROM q, (SELECT unnest(range(0, 4)) AS k)""")
def _(t):
    return sequences(t)[1]


@query("d10_snapshot_once", "SELECT min(event_id) AS captured, count(*) AS n FROM events")
def _(t):
    """A snapshot is written where there is none; the second one stays out."""
    taken = t.events.agg(F.min("event_id").alias("captured"), F.count(F.lit(1)).alias("n"))
    again = t.events.filter("event_id > 10").agg(F.min("event_id").alias("captured"), F.count(F.lit(1)).alias("n"))
    return taken.unionByName(again.join(taken.select(F.lit(True).alias("there")), F.lit(True), "left_anti"))
