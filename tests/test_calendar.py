import datetime as dt
import random

from pyspark.sql import functions as F

from calspark.operators import grid, identity, intervals, product, recurrence, reminders, slots
from calspark.sources import calendars, files

D, T = dt.date, dt.datetime
ENTRY = "subject string, event_id long, start_at timestamp_ntz, end_at timestamp_ntz, all_day boolean"


def made(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = T(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 3 * 1440))
        rows.append((rnd.choice("ab"), i, start, start + dt.timedelta(minutes=rnd.choice([15, 60, 300, 1500])), rnd.random() < 0.1))
    return rows, spark.createDataFrame(rows, ENTRY)


def test_conflicts_equal_brute_force(spark):
    """Also over midnight and with a hot subject; touching intervals don't conflict."""
    rows, df = made(spark)
    rows += [("t", 900, T(2024, 1, 1, 10), T(2024, 1, 1, 11), False), ("t", 901, T(2024, 1, 1, 11), T(2024, 1, 1, 12), False)]
    df = spark.createDataFrame(rows, ENTRY)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and not a[4] and not b[4] and a[2] < b[3] and a[3] > b[2]}
    got = [(r["event_a"], r["event_b"]) for r in intervals.conflicts(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lanes_never_overlap_and_are_as_many_as_the_peak(spark):
    rows, df = made(spark)
    lanes = intervals.lanes(df).collect()
    by = {r[1]: r for r in rows}
    for a in lanes:
        for b in lanes:
            if a["event_id"] < b["event_id"] and (a["subject"], a["day"], a["lane"]) == (b["subject"], b["day"], b["lane"]):
                x, y = by[a["event_id"]], by[b["event_id"]]
                assert x[3] <= y[2] or y[3] <= x[2]
    peak = {(r["subject"], r["day"]): r["peak"] for r in intervals.peak_concurrency(df).collect()}
    most = {}
    for r in lanes:
        most[r["subject"], r["day"]] = max(most.get((r["subject"], r["day"]), 0), r["lane"] + 1)
    assert most == peak


def test_lanes_equal_brute_force(spark):
    """The least lane whose last event is over, tried one by one, also with events of equal times."""
    rows, _ = made(spark, 200, 5)
    rows += [("t", 900 + i, T(2024, 1, 1, 10), T(2024, 1, 1, 10 + i % 2), False) for i in range(6)] + [("t", 990, None, T(2024, 1, 1), False)]
    want, ends = {}, {}
    for s, i, start, end, all_day in sorted((r for r in rows if r[2] and not r[4]), key=lambda r: (r[2], r[3], r[1])):
        day = ends.setdefault((s, start.date()), [])
        lane = next((n for n, e in enumerate(day) if e <= start), len(day))
        day[lane:lane + 1] = [end]
        want[i] = lane
    assert {r["event_id"]: r["lane"] for r in intervals.lanes(spark.createDataFrame(rows, ENTRY)).collect()} == want


def test_account_merges(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (4, "c")], "account_id long, platform string")
    requests = spark.createDataFrame([(2, 1), (3, 1), (4, 4), (4, 2), (4, 3)], "account_id long, new_account_id long")
    judged = {(r[0], r[1]): r[2] for r in identity.judged_moves(requests, own).collect()}
    assert judged == {(2, 1): None, (3, 1): "platform", (4, 4): "same", (4, 2): "platform", (4, 3): None}
    moves = spark.createDataFrame([(2, 1), (5, 1), (4, 3)], "account_id long, new_account_id long")
    preferences = spark.createDataFrame([(2, 8), (5, 9), (4, None), (3, 7)], "account_id long, hour int")
    assert sorted(tuple(r) for r in identity.merged_preferences(preferences, moves).filter("hour IS NOT NULL").collect()) == [(1, 8), (2, 8), (3, 7), (5, 9)]


def test_academic_weeks(spark):
    days = [(D(2026, 9, 1), D(2026, 9, 1)), (D(2026, 9, 1), D(2026, 9, 7)), (D(2026, 10, 12), D(2026, 10, 12)), (D(2027, 2, 8), D(2027, 2, 15)), (D(2030, 9, 1), D(2030, 9, 2))]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(days)], "i int, f date, d date").orderBy("i")
    assert [r[0] for r in df.select(recurrence.academic_week("f", "d")).collect()] == [1, 2, 7, 2, 1]


def test_odd_weeks_except_the_first(spark):
    series = spark.createDataFrame([(1, 0, D(2026, 9, 1), D(2026, 10, 4), "odd", 640, 730, [], [1])], "series_id long, weekday int, valid_from date, valid_until date, week_pattern string, start_min int, end_min int, weeks array<int>, except_weeks array<int>")
    skips = recurrence.skips_of_marks(series, "2026-08-01", "2026-12-31")
    got = recurrence.occurrences(series, skips, "2026-08-01", "2026-12-31").orderBy("occurrence_date").collect()
    assert [r["occurrence_date"] for r in got] == [D(2026, 9, 14), D(2026, 9, 28)]
    assert got[0]["start_at"] == T(2026, 9, 14, 10, 40) and got[0]["ref"] == "s:1:2026-09-14"


def test_rules(spark):
    rows = [("d", D(2024, 1, 1), "DAILY", 2, 3, None, None), ("w", D(2024, 1, 3), "WEEKLY", 1, 4, None, [0, 2]), ("m", D(2024, 1, 31), "MONTHLY", 1, None, D(2024, 5, 31), None), ("x", D(2024, 1, 1), "HOURLY", 1, 1, None, None), ("y", D(2024, 2, 29), "YEARLY", 1, None, None, None)]
    df = spark.createDataFrame(rows, "uid string, first_day date, freq string, interval_n int, count_n int, until_day date, by_days array<int>")
    got = {}
    for r in recurrence.rule_days(df, "2026-01-01").orderBy("uid", "day").collect():
        got.setdefault(r["uid"], []).append(r["day"])
    assert got == {"d": [D(2024, 1, 1), D(2024, 1, 3), D(2024, 1, 5)], "w": [D(2024, 1, 3), D(2024, 1, 8), D(2024, 1, 10), D(2024, 1, 15)], "m": [D(2024, 1, 31), D(2024, 3, 31), D(2024, 5, 31)], "x": [None], "y": [D(2024, 2, 29)]}


def test_retention_numbers(spark):
    registered = spark.createDataFrame([("a", T(2026, 6, 2))], "subject string, registered_at timestamp_ntz")
    activity = spark.createDataFrame([("a", T(2026, 6, 17)), ("a", T(2026, 6, 3))], "subject string, active_at timestamp_ntz")
    cohort = product.week_three(registered, activity, "2026-06-01 00:00:00", "2026-08-01 00:00:00")
    row = product.blended(cohort, 527, 35.0).first()
    assert (row["cohort"], row["retained"], row["percent"]) == (1, 1, 35.1)
    counts = spark.createDataFrame([(2,)], "n long")
    assert product.grown(527, counts, "n", 1).first()[0] == 528 and product.grown(7451, counts, "n", 0).first()[0] == 7453


def test_reminders_keep_the_earliest_and_the_latest(spark):
    e = spark.createDataFrame([(1, T(2024, 1, 3, 12), 5)], "event_id long, start_at timestamp_ntz, account_id long")
    valid = reminders.valid(reminders.standard(e), "2024-01-01 00:00:00")
    times = sorted(r["remind_at"] for r in valid.collect())
    assert times == [T(2024, 1, 2, 12), T(2024, 1, 3), T(2024, 1, 3, 11), T(2024, 1, 3, 11, 30)]
    prefs = spark.createDataFrame([(5, True, "balanced")], "account_id long, enabled boolean, frequency string")
    capped = reminders.capped(valid.withColumn("account_id", F.lit(5)), prefs)
    assert sorted(r["remind_at"] for r in capped.collect()) == times[2:]


def test_one_minute_deadlines_and_defaults(spark):
    df = spark.createDataFrame([(1435,), (1439,), (540,)], "c int")
    got = [tuple(r[0]) for r in df.select(grid.one_minute(F.col("c"))).collect()]
    assert got == [(1435, 1436), (1438, 1439), (540, 541)]


def test_undo_is_the_inverse_of_confirm(spark):
    batch = spark.createDataFrame([(7, 1, 3, "a", 0, 480, 540, "every"), (7, 2, 3, "a", 0, 480, 540, "every"), (7, 3, 3, "b", 1, 480, 540, "odd")], "draft_id long, position long, account_id long, title string, weekday int, start_min int, end_min int, week_pattern string")
    series = spark.createDataFrame([(3, "b", 1, 480, 540, "odd", "x")], "account_id long, title string, weekday int, start_min int, end_min int, week_pattern string, source string")
    new = slots.confirmed(batch, series)
    assert [(r["title"], r["position"]) for r in new.collect()] == [("a", 1)]
    after = series.unionByName(new.select(*series.columns))
    assert slots.confirmed(batch, after).count() == 0
    undone = slots.undone(after, spark.createDataFrame([("schedule_import:7",)], "source string"))
    assert undone.collect() == series.collect()


def test_calendar_texts(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  name\\, cut\r\nDTSTART;TZID=Europe/Moscow:20260907T170000\r\nDURATION:PT1H30M\r\nBEGIN:VALARM\r\nTRIGGER:-PT15M\r\nEND:VALARM\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:Día\r\nDTSTART;VALUE=DATE:20260908\r\nRRULE:FREQ=WEEKLY;COUNT=4\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    df = spark.createDataFrame([("a.ics", bytearray(b"\xef\xbb\xbf" + ics.encode())), ("b.ics", bytearray("BEGIN:VEVENT\nUID:3\nSUMMARY:Зачёт\nDTSTART:20260101T080000\nEND:VEVENT\n".encode("cp1251"))), ("c.ics", bytearray(b""))], "file_name string, content binary")
    got = {r["uid"]: r for r in calendars.events(df).collect()}
    assert got["1"]["summary"] == "Long name, cut" and got["1"]["start_at"] == T(2026, 9, 7, 14) and got["1"]["zone"] == "Europe/Moscow" and got["1"]["duration_min"] == 90 and got["1"]["alarm_min"] == -15
    assert got["2"]["all_day"] and got["2"]["rrule"] == "FREQ=WEEKLY;COUNT=4" and got["2"]["status"] == "CANCELLED" and got["3"]["summary"] == "Зачёт"


def test_archives_and_kinds(spark):
    docs = spark.createDataFrame([(1, "a.txt", bytearray(b"x")), (1, "b.txt", bytearray(b"y")), (2, "__MACOSX/c", bytearray(b"z"))], "box long, member string, content binary")
    boxes = files.archived(docs, "box")
    assert sorted((r["file_name"], r["member"], bytes(r["content"])) for r in files.members(boxes).collect()) == [("1.zip", "a.txt", b"x"), ("1.zip", "b.txt", b"y")]
    assert [tuple(r) for r in files.members(spark.createDataFrame([("bad.zip", bytearray(b"PK"))], boxes.schema)).collect()] == [("bad.zip", None, None, "broken")]
    assert {r[0] for r in boxes.select(files.file_kind(F.col("content"), F.col("file_name"))).collect()} == {"zip"}


def test_chunks(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bbbb"), (1, 2, "cc"), (1, 3, "d" * 20), (1, 4, "e")], "doc_id long, line_no int, text string")
    assert [r["chunk"] for r in grid.chunked(df, "doc_id", "line_no", 8).orderBy("line_no").collect()] == [0, 0, 1, 2, 3]


def test_chunks_equal_brute_force(spark):
    """Long documents too, lines of all lengths, empty ones and one without text."""
    rnd = random.Random(1)
    rows = [(d, i, rnd.choice([None, "", "x" * rnd.randint(1, 12)])) for d in (None, 1, 2) for i in range(30_000 if d == 2 else 40)]
    want, state = {}, {}
    for d, i, text in rows:
        chunk, used = state.get(d, (0, 0))
        n = len(text or "")
        chunk, used = (chunk + 1, n) if used and used + n > 20 else (chunk, used + n)
        want[d, i], state[d] = chunk, (chunk, used)
    got = grid.chunked(spark.createDataFrame(rows, "doc_id long, line_no int, text string"), "doc_id", "line_no", 20)
    assert {(r["doc_id"], r["line_no"]): r["chunk"] for r in got.collect()} == want


def test_date_formulas(spark):
    rows = [(1, 0, D(2026, 1, 1), None, None)] + [(1, i, None, i - 1, 7) for i in range(1, 6)] + [(1, 8, None, 9, 1), (1, 9, None, 8, 1)]
    df = spark.createDataFrame(rows, "file_id long, cell long, day date, ref long, plus int")
    got = {r["cell"]: r["day"] for r in grid.resolved_dates(df).collect()}
    assert got == {**{i: D(2026, 1, 1) + dt.timedelta(7 * i) for i in range(6)}, 8: None, 9: None}
