"""Axes, projection and questions on small sheets; expectations by hand."""

import pytest
from pyspark.sql import functions as F

from calspark.functions import text as T
from calspark.operators import grid, sheets
from calspark.sources import files


def frames(spark, rows, merges=()):
    cells = [(1, r, c, str(text)) for r, line in rows.items() for c, text in enumerate(line, 1) if text is not None]
    return spark.createDataFrame(cells, "file_id long, row_no int, col_no int, text string"), spark.createDataFrame([(1, *m) for m in merges], "file_id long, r1 int, c1 int, r2 int, c2 int")


PLAN = {
    1: [None, None, "Сверяйтесь с доской объявлений"], 2: ["2026-11-02 08:15"], 4: [None, None, "QX7", None, "ВШ"],
    6: ["Дни", "Часы", "Т11-301", "Т11-302", "Т11-309", "Т11-310"], 7: ["Понедельник", "8:30 - 9:55", "Оптика (лекция)", None, "Логика", "Право"], 8: [None, "10:05 - 11:30", "Плавание", "Графы", "Этика"],
}
MERGED = [(1, 3, 1, 6), (4, 3, 4, 4), (7, 3, 7, 4)]


def asked(spark, request, plan=PLAN, merged=MERGED):
    cells, merges = frames(spark, plan, merged)
    rows, requests = sheets.marked(cells, merges).cache(), spark.createDataFrame([(1, request)], "file_id long, request string")
    found = sheets.matched(rows, requests)
    columns = sheets.selected_columns(found).cache()
    kept = {(r["row_no"], r["col_no"]) for r in sheets.projected(rows, columns).collect()}
    return rows, {r["text"] for r in found.collect()}, kept, [r["choices"] for r in sheets.questions(rows, requests, columns).collect()]


@pytest.mark.parametrize(("request_", "columns", "labels"), [
    ("Т11-302", {1, 2, 3, 4}, {"Т11-302"}), ("группа 301", {1, 2, 3}, {"Т11-301"}), ("QX7 т11–302", {1, 2, 3, 4}, {"QX7", "Т11-302"}), ("QX7 302", {1, 2, 3, 4}, {"QX7", "Т11-302"}), ("вш", {1, 2, 5}, {"ВШ"}),
])
def test_a_named_label_keeps_its_columns(spark, request_, columns, labels):
    rows, found, kept, choices = asked(spark, request_)
    assert {r["row_no"] for r in rows.filter("header").collect()} == {1, 2, 4, 6}
    assert found == labels and {c for r, c in kept if r >= 7} == columns and choices == []
    assert ((7, 3) in kept) == (3 in columns)  # the lecture that two groups share


def test_two_groups_under_one_label_are_asked_about(spark):
    assert asked(spark, "QX7")[3] == [["Т11-301", "Т11-302"]]
    _, labels, kept, _ = asked(spark, "кто-то другой")
    assert labels == set() and len(kept) == 19
    assert asked(spark, "11-301")[1] == set()  # a part of a code is no code


def test_dates_stay_with_the_group(spark):
    plan = {1: ["Занятия, ноябрь 2026"], 2: ["Дата", "Пара", "Группа ЛМН-41", "Группа ЛМН-42"], 3: ["9 нояб. (пн)", "1 пара 8:30–10:00", "Почвы", "Карты"], 4: [None, "2 пара 10:10–11:40", "Карты", "Почвы"]}
    for request, kept_column, gone in (("лмн 42", 4, 3), ("группа ЛМН-41", 3, 4)):
        kept = asked(spark, request, plan, [(1, 1, 1, 4), (3, 1, 4, 1)])[2]
        assert {(3, kept_column), (4, kept_column), (3, 1), (3, 2), (4, 2)} <= kept and (3, gone) not in kept


def test_the_nearest_axis_and_the_times(spark):
    plan = {1: ["Дни", "Часы", "Ц07-111", "Дни", "Ц07-122"], 2: ["Понедельник", "8:30 - 9:55", "Вышивка", "Понедельник", "Лепка"], 3: ["Вторник", "10:05 - 11:30", "Гончары", "Вторник", "Роспись"]}
    columns = {c for _, c in asked(spark, "122", plan, [])[2]}
    assert columns == {1, 2, 4, 5}


def test_weekday_and_parity_hints(spark):
    plan = {
        1: ["День", "Неделя", "Вид", "Класс"], 2: ["понедельник", "I", "ср", "Резьба"], 3: [None, "II", "ср", "Пайка"], 4: ["вторник", "I", "ср", "Сборка"], 5: [None, "II", None, None],
        6: [None, None, None, "Обед"], 8: [None, None, "пн", "Ср."], 9: [None, None, "бег", "плавание"],
    }
    cells, merges = frames(spark, plan, [(2, 1, 3, 1), (4, 1, 5, 1), (4, 4, 5, 4)])
    days = {(r["row_no"], r["col_no"]): r["weekday"] for r in sheets.weekday_hints(cells, merges).collect()}
    assert days[2, 4] == 0 and days[3, 4] == 0 and days[4, 4] == 1 and (6, 4) not in days  # "ср" down the third column is a kind of class
    assert days[9, 3] == 0 and days[9, 4] == 2
    weeks = {(r["row_no"], r["col_no"]): r["week"] for r in sheets.parity_hints(cells, merges).collect()}
    assert weeks[2, 4] == "odd" and weeks[3, 4] == "even" and weeks[4, 4] == "every" and (6, 4) not in weeks and (2, 2) not in weeks
    alone = sheets.parity_hints(cells.filter("text <> 'II'"), merges)
    assert alone.collect() == []


def test_labels_of_axes(spark):
    texts = ["пн", "Среда.", "8:30 - 9:55", "2 пара 10:10–11:40", "9 нояб. (пн)", "2026-09-07", "3 урок", "Среда и ночь", "Химия 9:00", "12", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.is_axis_label(F.col("t"))).collect()] == [True] * 7 + [False] * 4 + [None]
    heads = spark.createDataFrame([(i, t) for i, t in enumerate(["Дни недели", "№ пары", "Время начала", "Дни открытых дверей", "Группа"])], "i int, t string").orderBy("i")
    assert [r[0] for r in heads.select(T.is_axis_header(F.col("t"))).collect()] == [True, True, True, False, False]


def test_label_of_a_word_after_a_number(spark):
    """Words are told without the white space before them, wherever they stand."""
    texts = {"2 пара": True, "Пн 2 урок": True, "9 нояб": True, "с 8:30 до 9:55": True, "2 парад": False, "2 пара и урок": False}
    df = spark.createDataFrame([*enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.is_axis_label(F.col("t"))).collect()] == [*texts.values()]


def test_formulas(spark):
    rows = [("A4+7", (None, 4, 1, 7)), ("= $B$12 - 3 + 1", (None, 12, 2, -2)), ("7+aa2", (None, 2, 27, 7)), ("DATE(2026,9,1)+7", ("2026-09-01", None, None, 7)), ("A1", (None, 1, 1, 0)),
            ("A1+B2", None), ("-A1", None), ("SUM(A1)", None), ("DATE(2026,2,31)", None), ("5+7", None), ("A1*2", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)], "i int, f string").orderBy("i")
    got = [r["x"] and (r["x"]["day"] and str(r["x"]["day"]), r["x"]["ref_row"], r["x"]["ref_col"], r["x"]["plus"]) for r in df.select(grid.parsed_formula(F.col("f")).alias("x")).collect()]
    assert got == [w for _, w in rows]


def test_long_chains_cycles_and_broken_workbooks(spark):
    chain = [(1, 1, 1, None, "DATE(2024,1,1)")] + [(1, i, 1, None, f"A{i - 1}+1") for i in range(2, 102)]
    loop = [(2, 1, 1, None, "A2+1"), (2, 2, 1, None, "A1+1"), (2, 3, 1, "2024-05-06", None), (2, 4, 1, None, "A3-6"), (2, 5, 1, None, "A9")]
    cells = spark.createDataFrame(chain + loop, "f long, row_no int, col_no int, text string, formula string")
    made = files.workbooks(cells, "f")
    declared = bytes(made.filter("file_name = '2.xlsx'").collect()[0]["content"])
    import io
    import zipfile

    def changed(name, change):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(declared)) as old, zipfile.ZipFile(out, "w") as new:
            for x in old.namelist():
                if (data := change(x, old.read(x))) is not None:
                    new.writestr(x, data)
        return (name, bytearray(out.getvalue()))

    bad = [
        changed("dtd.xlsx", lambda n, d: b'<!DOCTYPE x [<!ENTITY a "b">]>' + d if n.endswith("cells.xml") else d), changed("xml.xlsx", lambda n, d: d[:-9] if n.endswith("cells.xml") else d),
        changed("gone.xlsx", lambda n, d: None if n.endswith("cells.xml") else d), ("cut.xlsx", bytearray(declared[: len(declared) // 2])), ("none.xlsx", bytearray(b"text")),
    ]
    parts = files.workbook_parts(made.union(spark.createDataFrame(bad, made.schema)))
    assert {r["file_name"] for r in parts.filter("kind = 'broken'").collect()} == {n for n, _ in bad}
    days = {(r["file_name"], r["row_no"]): r["day"] and str(r["day"]) for r in grid.formula_dates(parts.filter("kind <> 'broken'"), ["file_name", "sheet"]).collect()}
    assert days["1.xlsx", 101] == "2024-04-10" and [days["2.xlsx", i] for i in range(1, 6)] == [None, None, "2024-05-06", "2024-04-30", None]


def test_a_corrupt_member_is_one_row(spark):
    df = spark.createDataFrame([(1, "a.txt", bytearray(b"x" * 2000)), (1, "b.txt", bytearray(b"fine"))], "k long, member string, content binary")
    whole = bytearray(files.archived(df, "k").collect()[0]["content"])
    at = whole.find(b"a.txt") + 5
    whole[at: at + 4] = b"\xff\xff\xff\xff"
    got = {r["member"]: (r["content"] and bytes(r["content"]), r["reject"]) for r in files.members(spark.createDataFrame([("z.zip", whole)], "file_name string, content binary")).collect()}
    assert got == {"a.txt": (None, "corrupt"), "b.txt": (b"fine", None)}


def test_small_workbooks_are_written_and_read_in_few_batches(spark):
    """No call of Python for each file: the cells of files stream by, sorted; rows and columns come in order whatever theirs is."""
    cells = spark.createDataFrame([(f, r, c, f"{f}-{r}-{c}" if c != 28 else None, "A1+7" if c == 28 else None, 3 if (r, c) == (2, 1) else None, 2 if (r, c) == (2, 1) else None) for f in (2, 1, 3) for r in (10, 2) for c in (28, 1)], "f int, row_no int, col_no int, text string, formula string, last_row int, last_col int")
    made = files.workbooks(cells, "f")
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, (tuple(r)[0:1] + tuple(r)[2:] for r in files.workbook_parts(made).collect())))
    want = [(f"{f}.xlsx", r, c, "number" if c == 28 else "text", None if c == 28 else f"{f}-{r}-{c}", "A1+7" if c == 28 else None, None, None) for f in (1, 2, 3) for r in (2, 10) for c in (1, 28)]
    assert got == sorted(map(str, want + [(f"{f}.xlsx", 2, 1, "merge", None, None, 3, 2) for f in (1, 2, 3)]))
