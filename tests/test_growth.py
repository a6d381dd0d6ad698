"""What keeps the time of queries in proportion to their tables: how plans are made, and that both ways of a choice give the same rows."""

from pyspark.sql import functions as F

from calspark import catalog
from calspark.functions import text as T
from calspark.operators import grid, sheets
from calspark.plans import texts
from calspark.sources import calendars

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_rows_are_told_by_patterns(spark):
    """Each cell is matched once, before cells are gathered; no function runs over the words of a row but one over its days."""
    cells = spark.createDataFrame([(1, 1, 0, "Четверг"), (1, 1, 1, "9:30"), (1, 1, 2, "Химия"), (1, 2, 1, "10:30 чет."), (1, 2, 2, "ИС-21"), (1, 2, 3, " "), (1, 2, 4, "Дата и время")], "file_id long, row_no int, col_no int, text string")
    rows = grid.row_slots(cells)
    assert plan(rows).count("lambdafunction") <= 2
    assert sorted(map(tuple, rows.collect())) == [(1, 1, 3, 570, 660, "Химия", "every", True), (1, 2, 3, 630, 720, "Дата и время", "even", True)]


def test_week_marks_without_tokens(spark):
    """Titles are matched as they are; a token behind white space other than a blank is no part of a mark."""
    titles = ["1-4 н. химия", "физика (кр. 5,1 нед)", "12 н", "ё\t30н", "Нед)5нед 12н", "a 3 н, b 4 н", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", T.week_marks(F.col("t")).alias("m")).orderBy("i")
    assert "regexp_extract_all" not in plan(rows)
    want = [([1, 2, 3, 4], [], "Химия"), ([], [1, 5], "Физика"), ([], [], "12 н"), ([], [], "ё\t30н"), ([12], [], "Нед)5нед"), ([4], [], "A 3 н, b"), ([], [], None)]
    assert [tuple(r["m"]) for r in rows.collect()] == want


def test_zones_are_found_in_small_groups(spark):
    assert max(map(len, calendars.ZONE_GROUPS)) < 30 and sorted(z for own in calendars.ZONE_GROUPS for z in own) == calendars.ZONES
    names = [*calendars.ZONES, "Europe", "", "|", "europe/berlin", *("|".join(own[:2]) for own in calendars.ZONE_GROUPS if len(own) > 1), None]
    found = spark.createDataFrame([(i, z) for i, z in enumerate(names)], "i int, z string").orderBy("i").select(calendars.known_zone(F.col("z"))).collect()
    assert [r[0] for r in found] == [True] * len(calendars.ZONES) + [False] * (len(names) - len(calendars.ZONES) - 1) + [None]


def test_marked_cells_are_made_once(spark):
    """What is made of marked cells starts from what was saved, not from the cells again."""
    cells = spark.createDataFrame([(1, 1, 1, "День"), (1, 1, 2, "Время"), (1, 1, 3, "AB-1"), (1, 2, 1, "Пн"), (1, 2, 2, "8:15"), (1, 2, 3, "x")], "file_id long, row_no int, col_no int, text string")
    merges = spark.createDataFrame([], "file_id long, r1 int, c1 int, r2 int, c2 int")
    rows = sheets.marked(cells, merges)
    assert "Join" not in plan(rows) and "LogicalRDD" in plan(rows)
    assert {(r["row_no"], r["col_no"]): (r["header"], r["axis"]) for r in rows.collect()} == {(1, 1): (True, True), (1, 2): (True, True), (1, 3): (True, False), (2, 1): (False, True), (2, 2): (False, True), (2, 3): (False, False)}


def test_few_scores_are_broadcast_and_many_joined(spark, monkeypatch):
    run = lambda: catalog.queries()["t6_title_similarity"](spark, SF)
    few = run()
    assert "strategy=broadcast" in plan(few)
    monkeypatch.setattr(texts, "MOST_SCORES", 10)
    many = run()
    assert "strategy=broadcast" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
