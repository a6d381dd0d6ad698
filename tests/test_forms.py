"""Forms in which dates, clocks, weeks, calendar rules and fields are written; expectations by hand."""

import datetime as dt

from pyspark.sql import functions as F

from calspark.functions import text as T
from calspark.sources import calendars, files

D, M = dt.date, dt.datetime


def of(spark, column, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_dates(spark):
    today = F.lit("2026-03-10").cast("date")
    got = of(spark, T.date_range(F.col("text"), today), "с 01/09/2026 по 31/12/2026", "1-4-26 - 30-6-26", "с 5.04 по 7.04", "с 1 сентября 2026 по 31 декабря 2026", "АБВГ-07-21 и ЭК-31-2", "с 1.9.26 по 2.9.26")
    assert [(r["first"], r["last"]) for r in got] == [(D(2026, 9, 1), D(2026, 12, 31)), (D(2026, 4, 1), D(2026, 6, 30)), (D(2026, 4, 5), D(2026, 4, 7)), (D(2026, 9, 1), D(2026, 12, 31)), (None, None), (D(2026, 9, 1), D(2026, 9, 2))]
    assert of(spark, T.occurrence_date(F.col("text"), today), "зачёт 12/03", "зачёт 1-2-27", "31.04", "группа АБ-03-19") == [D(2026, 3, 12), D(2027, 2, 1), None, None]
    assert of(spark, T.is_bare_period(F.col("text")), "01/09/2026 - 31/12/2026", "экзамен 01/09/2026 31/12/2026") == [True, False]


def test_clocks_and_weeks(spark):
    assert of(spark, F.array_sort(T.clocks(F.col("text"))), "в 9 ч и 10:30", "18 часов", "9 человек") == [[540, 630], [1080], []]
    got = of(spark, T.week_marks(F.col("text")), "1,5 н. физика", "физика 2-4 н.", "(кр. 1 н.) физика", "физика, кр 3 нед", "2-3н.: химия", "физика", "24 ночи")
    assert [(list(r["weeks"]), list(r["except_weeks"]), r["title"]) for r in got] == [([1, 5], [], "Физика"), ([2, 3, 4], [], "Физика"), ([], [1], "Физика"), ([], [3], "Физика"), ([2, 3], [], "Химия"), ([], [], "физика"), ([], [], "24 ночи")]
    assert of(spark, T.transcript(F.col("text")), "Редактор субтитров", "DimaTorzok", "без 5.10 сбор") == ["", "", "без 5 минут 10 сбор"]


ICS = """BEGIN:VCALENDAR
X-WR-CALNAME:Study
BEGIN:VEVENT
UID:a
SUMMARY:Lesson
DTSTART;TZID=Europe/Berlin:20260323T090000
DTEND;TZID=Europe/Berlin:20260323T100000
RRULE:FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4
EXDATE;TZID=Europe/Berlin:20260325T090000
stray line
BEGIN:VALARM
TRIGGER:-PT10M
DURATION:PT5M
END:VALARM
BEGIN:VALARM
TRIGGER;RELATED=END:PT0M
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:a
SUMMARY:Moved
RECURRENCE-ID;TZID=Europe/Berlin:20260330T090000
DTSTART;TZID=Europe/Berlin:20260331T120000
END:VEVENT
BEGIN:VEVENT
UID:b
DTSTART:20260101T080000Z
RRULE:FREQ=MONTHLY;BYMONTHDAY=-1
END:VEVENT
BEGIN:VEVENT
UID:c
DTSTART;TZID=Nowhere/Else:20260101T080000
BEGIN:VALARM
TRIGGER;VALUE=DATE-TIME:20251231T200000Z
END:VALARM
END:VEVENT
END:VCALENDAR
"""


def test_calendar_rules_exceptions_and_alarms(spark):
    read = calendars.events(spark.createDataFrame([("x.ics", bytearray(ICS.encode()))], "file_name string, content binary")).cache()
    rows = {(r["uid"], r["place"]): r for r in read.collect()}
    assert rows["a", 0]["calendar"] == "Study" and rows["a", 0]["start_at"] == M(2026, 3, 23, 8) and rows["a", 0]["duration_min"] is None
    assert rows["a", 0]["alarms"] == [M(2026, 3, 23, 7, 50), M(2026, 3, 23, 9)] and rows["c", 3]["alarms"] == [M(2025, 12, 31, 20)]
    assert rows["c", 3]["start_at"] == M(2026, 1, 1, 8)
    got = sorted((r["uid"], r["summary"] or "", r["start_at"], r["broken"]) for r in calendars.occurrences(read.filter("uid <> 'c'"), "2027-01-01").collect())
    # the clock stays at nine o'clock when summer time begins (29 March); a rule that isn't understood is flagged
    assert got == [("a", "Lesson", M(2026, 3, 23, 8), False), ("a", "Lesson", M(2026, 4, 1, 7), False), ("a", "Moved", M(2026, 3, 31, 10), False), ("b", "", M(2026, 1, 1, 8), True)]


def test_quoted_fields(spark):
    made = [("a.csv", '1,"Smith, John",x\r\n2,"two\nlines","say ""hi"""\n3,,"open'), ("b.csv", 'a;"b;c";d')]
    df = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in made], "file_name string, content binary")
    got = sorted(map(tuple, files.delimited(df).collect()))
    assert got == [("a.csv", 1, 1, "1"), ("a.csv", 1, 2, "Smith, John"), ("a.csv", 1, 3, "x"), ("a.csv", 2, 1, "2"), ("a.csv", 2, 2, "two\nlines"), ("a.csv", 2, 3, 'say "hi"'), ("a.csv", 3, 1, "3"), ("a.csv", 3, 3, '"open'), ("b.csv", 1, 1, "a"), ("b.csv", 1, 2, "b;c"), ("b.csv", 1, 3, "d")]


def test_broken_workbooks_and_wide_sheets(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 26, "z"), (1, 1, 27, "aa"), (1, 2, 703, "aaa")], "file_id long, row_no int, col_no int, text string")
    made = files.workbooks(cells, "file_id").union(spark.createDataFrame([("bad.xlsx", bytearray(b"PK no"))], "file_name string, content binary"))
    got = sorted(((r["file_name"], r["row_no"], r["col_no"], r["kind"]) for r in files.workbook_cells(made).collect()), key=str)
    assert got == [("1.xlsx", 1, 1, "text"), ("1.xlsx", 1, 26, "text"), ("1.xlsx", 1, 27, "text"), ("1.xlsx", 2, 703, "text"), ("bad.xlsx", None, None, "broken")]
