"""Calendar tables derived from the given ones, for Spark and for DuckDB from one template each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

VIEWS = {
    "v_users": """
SELECT user_id, user_id AS external_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS platform, min(ts) AS created_at
FROM events GROUP BY user_id""",
    "v_identities": """
SELECT $DIV(user_id,2) AS account_id, platform, external_id, created_at FROM v_users WHERE $DIV(user_id,2) % 3 <> 0""",
    "v_cal_events": """
SELECT e.event_id, e.user_id, u.platform, concat(p.p_name, ' ', e.event_type) AS title,
       CASE WHEN e.event_type = 'error' THEN 'draft' ELSE 'confirmed' END AS status,
       e.event_type = 'purchase' AS is_completed,
       e.event_type = 'signup' AND e.event_id % 4 = 0 AS all_day,
       CASE WHEN e.event_type = 'signup' AND e.event_id % 4 = 0 THEN CAST(date_trunc('day', e.ts) AS $TS)
            ELSE CAST(date_trunc('minute', e.ts) AS $TS) END AS start_at,
       CASE WHEN e.event_type = 'signup' AND e.event_id % 4 = 0
            THEN CAST(date_trunc('day', e.ts) AS $TS) + $DAY(CAST(1 + e.event_id % 3 AS INT))
            ELSE CAST(date_trunc('minute', e.ts) AS $TS) + $MIN(CAST(floor(e.value) AS INT) + 15) END AS deadline,
       e.ts AS created_at
FROM events e JOIN v_users u ON u.user_id = e.user_id JOIN part p ON p.p_partkey = $JSONK(e.props)""",
    "v_event_timings": """
SELECT event_id, start_at, deadline AS end_at, all_day FROM v_cal_events WHERE event_id % 10 <> 0""",
    "v_reminders": """
SELECT e.event_id * 3 + i.i AS reminder_id, e.event_id, e.start_at - $MIN(CAST((i.i + 1) * 45 AS INT)) AS remind_at,
       CASE WHEN (e.event_id + i.i) % 5 = 0 THEN 'sent' ELSE 'pending' END AS status
FROM v_cal_events e CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) i""",
    "v_series": """
SELECT p_partkey AS series_id, p_partkey % 75 AS account_id, p_name AS title, p_size % 7 AS weekday,
       CAST(480 + (p_partkey % 8) * 90 AS INT) AS start_min, CAST(570 + (p_partkey % 8) * 90 AS INT) AS end_min,
       CAST(TIMESTAMP '2024-01-01 00:00:00' + $DAY(CAST(p_partkey % 60 AS INT)) AS DATE) AS valid_from,
       CAST(TIMESTAMP '2024-01-01 00:00:00' + $DAY(CAST(p_partkey % 60 + 28 + p_size AS INT)) AS DATE) AS valid_until,
       CASE p_partkey % 3 WHEN 0 THEN 'every' WHEN 1 THEN 'odd' ELSE 'even' END AS week_pattern,
       concat('schedule_import:', CAST($DIV(p_partkey,20) AS $STR)) AS source
FROM part""",
    "v_series_exceptions": """
SELECT series_id, CAST(CAST(valid_from AS $TS) + $DAY(CAST(7 + (weekday - $WD(valid_from) + 7) % 7 AS INT)) AS DATE) AS occurrence_date,
       'skipped' AS status
FROM v_series WHERE series_id % 4 = 0""",
    "v_preferences": """
SELECT DISTINCT account_id, account_id % 5 <> 0 AS enabled,
       CASE account_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'balanced' ELSE 'frequent' END AS frequency,
       CAST(7 + account_id % 4 AS INT) AS summary_hour,
       CAST(CASE account_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 180 END AS INT) AS snooze_minutes
FROM v_identities WHERE account_id % 7 <> 0""",
    "v_turns": """
SELECT conv_id * 1000 + turn AS turn_id, conv_id AS account_id, role, text AS content,
       CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN concat('t:', CAST(conv_id AS $STR)) END AS event_ref
FROM conversations""",
    "v_subject_users": """
SELECT c.c_custkey AS user_id, $DIV(c.c_custkey,2) AS subject_id, min(o.o_orderdate) AS registered_at
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""",
    "v_activity": """
SELECT $DIV(o_custkey,2) AS subject_id, o_orderdate AS active_at FROM orders""",
    "v_inbox": """
SELECT $SHA(concat(event_type, ':', CAST(user_id AS $STR), ':', CAST(CAST(ts AS DATE) AS $STR))) AS inbox_key,
       event_id, ts AS created_at, props AS payload,
       CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'done' END AS status,
       CAST(event_id % 7 AS INT) AS attempts
FROM events""",
    "v_slots": """
SELECT $DIV(l_orderkey,10) AS draft_id, l_orderkey * 10 + l_linenumber AS position, p.p_name AS title, CAST(l_linenumber % 7 AS INT) AS weekday,
       CAST(480 + l_linenumber * 60 AS INT) AS start_min, CAST(540 + l_linenumber * 60 AS INT) AS end_min,
       CASE WHEN l_returnflag = 'R' THEN 'odd' WHEN l_returnflag = 'A' THEN 'even' ELSE 'every' END AS week_pattern,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS occurrence_date,
       CAST(1.0 AS DOUBLE) - l_discount AS confidence
FROM lineitem JOIN part p ON p.p_partkey = l_partkey""",
    "v_cells": """
SELECT $DIV(p_partkey,100) AS file_id, CAST($DIV(p_partkey % 100, 5) + 1 AS INT) AS row_no, CAST(p_partkey % 5 + 1 AS INT) AS col_no,
       CASE WHEN $DIV(p_partkey % 100, 5) % 5 = 0
            THEN CAST(CAST(TIMESTAMP '2024-01-01 00:00:00' + $DAY(CAST(p_partkey % 100 AS INT)) AS DATE) AS $STR)
            WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ', $LPAD(CAST(8 + p_size % 10 AS $STR)), ':30')
            ELSE p_name END AS text
FROM part""",
}
SPARK = {"TS": "TIMESTAMP_NTZ", "STR": "STRING", "DIV": "({0} div {1})", "DAY": "make_dt_interval({0},0,0,0)", "MIN": "make_dt_interval(0,0,{0},0)", "WD": "weekday({0})", "JSONK": "CAST(get_json_object({0},'$.k') AS BIGINT)", "SHA": "sha2({0},256)", "LPAD": "lpad({0},2,'0')"}
DUCK = {"TS": "TIMESTAMP", "STR": "VARCHAR", "DIV": "({0} // {1})", "DAY": "to_days({0})", "MIN": "to_minutes({0})", "WD": "(isodow({0}) - 1)", "JSONK": "CAST(json_extract_string({0},'$.k') AS BIGINT)", "SHA": "sha256({0})", "LPAD": "lpad({0},2,'0')"}


def expanded(sql: str, engine: dict[str, str]) -> str:
    """The template with each $NAME or $NAME(arguments) written for an engine."""
    while m := re.search(r"\$([A-Z]+)", sql):
        form, start, end = engine[m[1]], m.start(), m.end()
        if "{0}" not in form:
            sql = sql[:start] + form + sql[end:]
            continue
        depth, at, parts = 0, end, [""]
        while True:
            c = sql[at]
            depth += (c == "(") - (c == ")")
            if not depth:
                break
            if c == "," and depth == 1:
                parts.append("")
            elif not (c == "(" and depth == 1):
                parts[-1] += c
            at += 1
        sql = sql[:start] + form.format(*(p.strip() for p in parts)) .replace("$.k", "\0") + sql[at + 1:]
    return sql.replace("\0", "$.k")


def needed(sql: str) -> list[str]:
    """The views that a statement uses, each after those it uses itself."""
    used = {n for n in VIEWS if re.search(rf"\b{n}\b", sql)}
    while more := {m for n in used for m in VIEWS if re.search(rf"\b{m}\b", VIEWS[n])} - used:
        used |= more
    return [n for n in VIEWS if n in used]


def duck(sql: str) -> str:
    """A statement for DuckDB, with the views that it uses."""
    views = ", ".join(f"{n} AS ({expanded(VIEWS[n], DUCK)})" for n in needed(sql))
    if not views:
        return sql
    body = sql.strip()
    recursive = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {'RECURSIVE ' if recursive and recursive[1] else ''}{views}" + (f", {body[recursive.end():]}" if recursive else f" {body}")


class Tables:
    """The given tables and the derived ones of a folder, as data frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        view = f"v_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        bases = [b for b in BASE if any(re.search(rf"\b{b}\b", VIEWS[n]) for n in needed(view))]
        ctes = [f"{b} AS (SELECT * FROM parquet.`{self.sf_dir}/{b}.parquet`)" for b in bases]
        ctes += [f"{n} AS ({expanded(VIEWS[n], SPARK)})" for n in needed(view)]
        return self.spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {view}")
