"""Queries over sheets of cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calspark.functions import text as T
from calspark.operators import grid, sheets
from calspark.sources import files

from .registry import query

DATE = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
HINTS = f"""
headers AS (SELECT file_id, row_no FROM v_cells GROUP BY file_id, row_no HAVING count(*) FILTER (WHERE regexp_matches(text, {DATE})) >= 2 AND count(*) FILTER (WHERE NOT regexp_matches(text, {DATE})) <= 1),
marked AS (SELECT c.*, h.row_no IS NOT NULL AS header FROM v_cells c LEFT JOIN headers h ON h.file_id = c.file_id AND h.row_no = c.row_no),
hinted AS (SELECT *, last_value(CASE WHEN header THEN text END IGNORE NULLS) OVER (PARTITION BY file_id, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS d FROM marked),
hints AS (SELECT file_id, row_no, col_no, text, CAST(d AS DATE) AS date_hint FROM hinted WHERE NOT header)"""


def hints(t):
    return grid.date_hints(t.cells, grid.header_rows(t.cells))


def merges(t):
    return t.cells.filter("row_no % 5 = 2 AND col_no = 2").select("file_id", F.col("row_no").alias("r1"), F.col("col_no").alias("c1"), (F.col("row_no") + 1).alias("r2"), (F.col("col_no") + 1).alias("c2"))


@query("g2_merged_fill", """
WITH m AS (SELECT file_id, row_no AS r1, text FROM v_cells WHERE row_no % 5 = 2 AND col_no = 2)
SELECT c.file_id, c.row_no, c.col_no, coalesce(m.text, c.text) AS text FROM v_cells c LEFT JOIN m ON m.file_id = c.file_id AND c.row_no BETWEEN m.r1 AND m.r1 + 1 AND c.col_no BETWEEN 2 AND 3""")
def _(t):
    return grid.filled(t.cells, merges(t))


@query("j15_containment", """
WITH m AS (SELECT file_id, row_no AS r1 FROM v_cells WHERE row_no % 5 = 2 AND col_no = 2)
SELECT c.file_id, c.row_no, c.col_no, m.r1, 2 AS c1 FROM v_cells c JOIN m ON m.file_id = c.file_id AND c.row_no BETWEEN m.r1 AND m.r1 + 1 AND c.col_no BETWEEN 2 AND 3""")
def _(t):
    places = merges(t).select("file_id", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row_no"), "c2").select("file_id", "r1", "c1", "row_no", F.explode(F.sequence("c1", "c2")).alias("col_no"))
    return t.cells.join(places, grid.CELL).select(*grid.CELL, "r1", "c1")


@query("a14_row_counters", f"SELECT file_id, row_no, count(*) FILTER (WHERE regexp_matches(text, {DATE})) AS n_dates, count(*) FILTER (WHERE NOT regexp_matches(text, {DATE})) AS n_labels FROM v_cells GROUP BY file_id, row_no")
def _(t):
    dates = F.count_if(T.is_pure_date(F.col("text")))
    return t.cells.groupBy("file_id", "row_no").agg(dates.alias("n_dates"), (F.count(F.lit(1)) - dates).alias("n_labels"))


@query("g3_header_rows", f"WITH {HINTS} SELECT file_id, row_no FROM headers")
def _(t):
    return grid.header_rows(t.cells).select("file_id", "row_no")


@query("g4_date_hints", f"WITH {HINTS} SELECT file_id, row_no, col_no, date_hint FROM hints")
def _(t):
    return hints(t).select(*grid.CELL, "date_hint")


@query("j14_asof_header", f"WITH {HINTS} SELECT date_hint, count(*) AS n FROM hints GROUP BY date_hint")
def _(t):
    return hints(t).groupBy("date_hint").agg(F.count(F.lit(1)).alias("n"))


@query("j16_evidence", f"WITH {HINTS} SELECT file_id, row_no, col_no FROM hints WHERE regexp_matches(text, ' (08|09|10|11|12):30$') AND date_hint IS NOT NULL")
def _(t):
    wanted = t.spark.range(8, 13).select((F.col("id") * 60 + 30).cast("int").alias("clock"))
    cells = hints(t).filter("date_hint IS NOT NULL").select(*grid.CELL, F.explode(T.clocks(F.col("text"))).alias("clock"))
    return cells.join(wanted, "clock", "left_semi").select(*grid.CELL).distinct()


@query("j17_label_match", """
WITH l AS (SELECT DISTINCT lower(p_type) AS label FROM part), d AS (SELECT conv_id, turn, text FROM conversations)
SELECT d.conv_id, d.turn, l.label FROM d JOIN l ON contains(' ' || regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(l.label, '[^a-z0-9]+', ' ', 'g') || ' ')""")
def _(t):
    """Labels are found by their first word, an equal key, and then compared whole."""
    folded = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    labels = t.part.select(F.lower("p_type").alias("label")).distinct().withColumn("folded", folded("label")).withColumn("word", F.split("folded", " ")[0])
    said = t.conversations.select("conv_id", "turn", F.concat(F.lit(" "), folded("text"), F.lit(" ")).alias("said"))
    words = said.select("conv_id", "turn", "said", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    return words.join(labels, "word").filter(F.col("said").contains(F.concat(F.lit(" "), "folded", F.lit(" ")))).select("conv_id", "turn", "label")


@query("w8_carry_forward", "SELECT file_id, row_no, col_no, last_value(CASE WHEN row_no % 4 = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY file_id, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS label FROM v_cells")
def _(t):
    return grid.carried(t.cells, F.when(F.col("row_no") % 4 == 1, F.col("text")), "label").select(*grid.CELL, "label")


@query("g16_carried_context", "SELECT file_id, row_no, col_no, last_value(CASE WHEN length(text) < 14 THEN text END IGNORE NULLS) OVER (PARTITION BY file_id, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS context FROM v_cells")
def _(t):
    return grid.carried(t.cells, F.when(F.length("text") < 14, F.col("text")), "context").select(*grid.CELL, "context")


@query("w9_block_extents", f"""
WITH {HINTS}, x AS (SELECT file_id, row_no, lead(row_no) OVER (PARTITION BY file_id ORDER BY row_no) AS n FROM headers), l AS (SELECT file_id, max(row_no) AS last_row FROM v_cells GROUP BY file_id)
SELECT x.file_id, x.row_no AS first_row, coalesce(n - 1, last_row) AS end_row FROM x JOIN l ON l.file_id = x.file_id""")
def _(t):
    return grid.extents(grid.header_rows(t.cells), t.cells.groupBy("file_id").agg(F.max("row_no").alias("last_row")))


@query("g5_weekday_hint", "SELECT series_id, weekday FROM v_series")
def _(t):
    names = F.array(*map(F.lit, ("Понедельник", "вторник", "Среда", "четверг", "пятница", "СУББОТА", "воскресенье")))
    return t.series.select("series_id", T.weekday_index(F.element_at(names, (F.col("weekday") + 1).cast("int"))).alias("weekday"))


@query("g6_parity_hint", """
WITH w AS (SELECT file_id, row_no, min(CASE WHEN col_no = 1 THEN row_no % 3 END) AS k FROM v_cells GROUP BY file_id, row_no)
SELECT file_id, row_no // 4 AS block, CASE WHEN count(DISTINCT CASE WHEN k < 2 THEN k END) = 2 THEN 'every' WHEN max(CASE WHEN k < 2 THEN k END) = 0 THEN 'odd' WHEN max(CASE WHEN k < 2 THEN k END) = 1 THEN 'even' END AS parity FROM w GROUP BY 1, 2""")
def _(t):
    rows = t.cells.filter("col_no = 1").selectExpr("file_id", "row_no div 4 AS block", "CASE row_no % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' END AS mark")
    weeks = rows.groupBy("file_id", "block").agg(F.collect_set(F.when(F.col("mark") == "I", "odd").when(F.col("mark") == "II", "even")).alias("p"))
    return weeks.select("file_id", "block", F.when(F.size("p") == 2, "every").otherwise(F.try_element_at("p", F.lit(1))).alias("parity"))


@query("g7_header_extent", "SELECT file_id, least(coalesce(min(CASE WHEN regexp_matches(text, ' [0-9]{2}:30$') THEN row_no END) - 1, 3), 12) AS header_rows FROM v_cells GROUP BY file_id")
def _(t):
    return grid.header_extent(t.cells)


@query("g8_axis_columns", "SELECT file_id, col_no FROM v_cells WHERE row_no > 1 GROUP BY file_id, col_no HAVING bool_and(length(text) > 6)")
def _(t):
    return grid.axis_columns(t.cells.filter("row_no > 1"), F.length("text") > 6)


@query("u5_span_intersection", "SELECT file_id, col_no FROM v_cells WHERE row_no IN (2, 3, 4) AND length(text) > 10 GROUP BY file_id, col_no HAVING count(DISTINCT row_no) = 3")
def _(t):
    rows = t.cells.filter(F.col("row_no").isin(2, 3, 4) & (F.length("text") > 10))
    return rows.groupBy("file_id", "col_no").agg(F.countDistinct("row_no").alias("levels")).filter("levels = 3").select("file_id", "col_no")


@query("g9_ambiguity", "SELECT file_id, row_no, count(DISTINCT text) AS n_groups, count(DISTINCT text) > 1 AS ambiguous FROM v_cells WHERE row_no <= 3 GROUP BY file_id, row_no")
def _(t):
    return t.cells.filter("row_no <= 3").groupBy("file_id", "row_no").agg(F.countDistinct("text").alias("n_groups")).withColumn("ambiguous", F.col("n_groups") > 1)


@query("w13_column_blocks", """
WITH c AS (SELECT DISTINCT file_id, col_no FROM v_cells WHERE col_no <> 3), g AS (SELECT *, CASE WHEN col_no - lag(col_no) OVER (PARTITION BY file_id ORDER BY col_no) <= 1 THEN 0 ELSE 1 END AS new FROM c),
b AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY col_no) AS block FROM g) SELECT file_id, CAST(block AS BIGINT) AS block, min(col_no) AS first_col, max(col_no) AS last_col FROM b GROUP BY file_id, block""")
def _(t):
    return grid.islands(t.cells.filter("col_no <> 3").select("file_id", "col_no").distinct())


@query("g10_nearest_block", """
WITH c AS (SELECT DISTINCT file_id, col_no FROM v_cells) SELECT file_id, col_no, CASE WHEN col_no <= 3 THEN 1 ELSE 2 END AS block FROM c WHERE col_no <> 3 OR true""")
def _(t):
    """The nearest block of axis columns, the left one of two as near."""
    columns = t.cells.select("file_id", "col_no").distinct()
    blocks = grid.islands(columns.filter("col_no <> 3"))
    near = F.greatest(F.col("first_col") - F.col("col_no"), F.col("col_no") - F.col("last_col"), F.lit(0))
    return columns.join(blocks, "file_id").groupBy("file_id", "col_no").agg(F.min_by("block", F.struct(near.alias("d"), F.col("first_col"))).cast("int").alias("block"))


@query("g11_row_slots", f"""
WITH {HINTS} SELECT file_id, row_no, col_no, date_hint AS day, (CAST(regexp_extract(text, '([0-9]{{2}}):30$', 1) AS INT) * 60 + 30) AS start_min, least(CAST(regexp_extract(text, '([0-9]{{2}}):30$', 1) AS INT) * 60 + 120, 1439) AS end_min,
  trim(regexp_replace(text, ' [0-9]{{2}}:30$', '')) AS title FROM hints WHERE regexp_matches(text, ' [0-9]{{2}}:30$') AND date_hint IS NOT NULL""")
def _(t):
    rows = hints(t).filter("date_hint IS NOT NULL").withColumn("clocks", T.clocks(F.col("text"))).filter(F.size("clocks").between(1, 2))
    title = F.trim(F.regexp_replace("text", T.CLOCK, ""))
    span = grid.default_interval(F.col("clocks")[0], F.try_element_at("clocks", F.lit(2)), F.lit(False))
    return rows.filter(title != "").select(*grid.CELL, F.col("date_hint").alias("day"), span["start_min"].alias("start_min"), span["end_min"].alias("end_min"), title.alias("title"))


TIMETABLE = """
r AS (SELECT draft_id AS file_id, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY position, title, week_pattern) AS INT) AS row_no, start_min, end_min, week_pattern, title,
    CASE WHEN position % 3 <> 0 THEN CAST(weekday AS INT) END AS day, CASE WHEN position % 11 = 0 THEN title || ' 2' END AS second, position FROM v_slots),
  c AS (SELECT *, last_value(day IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no) AS weekday,
    CASE WHEN position % 4 = 0 THEN start_min + 90 WHEN position % 13 = 0 THEN start_min - 30 ELSE end_min END AS last FROM r)"""


@query("g11_timetable_rows", f"""
WITH {TIMETABLE} SELECT file_id, row_no, weekday, start_min, last AS end_min, CASE WHEN second IS NULL AND last > start_min THEN title END AS title,
  CASE WHEN second IS NULL AND last > start_min THEN week_pattern END AS week_pattern, second IS NULL AND last > start_min AS resolved FROM c WHERE weekday IS NOT NULL""")
def _(t):
    """Rows of a day (not in all), one or two clocks, a number, a group, a title (or two) and the weeks beside the clocks; days come from the rows above."""
    days = F.array(*(F.lit(own[i % 3].capitalize()) for i, own in enumerate(T.DAY_NAMES)))
    clock = lambda m: F.concat_ws(":", F.floor(m / 60).cast("string"), F.lpad((m % 60).cast("string"), 2, "0"))
    n, weeks = F.col("position"), F.col("week_pattern")
    end = F.when(n % 13 == 0, F.col("start_min") - 30).otherwise(F.col("end_min"))
    times = F.when(n % 4 == 0, clock(F.col("start_min"))).otherwise(F.concat_ws(" - ", clock(F.col("start_min")), clock(end)))
    told = F.when(weeks == "odd", " (числитель)").when(weeks == "even", ", четная").otherwise("")
    second = F.when(n % 11 == 0, F.concat("title", F.lit(" 2"))).otherwise(F.concat(F.lit(" "), "title"))
    texts = [F.when(n % 3 != 0, F.get(days, F.col("weekday"))), F.concat(F.lit("№ "), (n % 7).cast("string")), F.concat(times, told), F.lit("ИС-21"), F.col("title"), second]
    place = F.row_number().over(Window.partitionBy("draft_id").orderBy("position", "title", "week_pattern"))
    rows = t.slots.select(F.col("draft_id").alias("file_id"), place.alias("row_no"), F.array(*texts).alias("texts"))
    return grid.row_slots(rows.select("file_id", "row_no", F.posexplode("texts").alias("col_no", "text")))


@query("g12_interval_defaults", """
SELECT position, CASE WHEN position % 3 = 0 THEN greatest(start_min - 30, 0) ELSE start_min END AS start_min, CASE WHEN position % 3 = 0 THEN start_min WHEN position % 3 = 1 THEN end_min ELSE least(start_min + 90, 1439) END AS end_min FROM v_slots""")
def _(t):
    span = grid.default_interval(F.col("start_min"), F.when(F.col("position") % 3 == 1, F.col("end_min")), F.col("position") % 3 == 0)
    return t.slots.select("position", span["start_min"].alias("start_min"), span["end_min"].alias("end_min"))


@query("g13_proposals", f"""
WITH {HINTS}, p AS (SELECT file_id, row_no, CASE WHEN row_no % 7 = 0 THEN 99 ELSE col_no END AS col_no, CASE WHEN col_no = 4 THEN 'invented' ELSE split_part(text, ' ', 1) END AS title, 570 AS start_min FROM v_cells)
SELECT p.file_id, p.row_no, p.col_no, p.title, CASE WHEN h.text IS NULL THEN 'cell' WHEN NOT contains(lower(h.text), lower(p.title)) THEN 'title' WHEN NOT regexp_matches(h.text, ' 09:30$') THEN 'time' WHEN h.date_hint IS NULL THEN 'date' END AS reason
FROM p LEFT JOIN hints h ON h.file_id = p.file_id AND h.row_no = p.row_no AND h.col_no = p.col_no""")
def _(t):
    p = t.cells.select("file_id", "row_no", F.when(F.col("row_no") % 7 == 0, 99).otherwise(F.col("col_no")).alias("col_no"), F.when(F.col("col_no") == 4, "invented").otherwise(F.split("text", " ")[0]).alias("title"), F.lit(570).alias("start_min"), F.lit(None).cast("date").alias("date"))
    return grid.verified(p, hints(t)).select(*grid.CELL, "title", "reason")


@query("g14_missed_cells", "SELECT file_id, row_no, col_no FROM v_cells WHERE regexp_matches(text, ' [0-9]{2}:30$') AND col_no % 2 = 0")
def _(t):
    return grid.missed(t.cells, t.cells.filter("col_no % 2 = 1")).select(*grid.CELL)


@query("g15_timeless_cells", "SELECT file_id, count(*) AS n FROM v_cells WHERE length(text) >= 12 AND NOT regexp_matches(text, ' [0-9]{2}:30$') AND NOT regexp_matches(text, '^[0-9.]+$') GROUP BY file_id")
def _(t):
    rows = t.cells.filter((F.length("text") >= 12) & (F.size(T.clocks(F.col("text"))) == 0) & ~F.col("text").rlike("^[0-9.]+$"))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("g17_sheet_selection", "SELECT file_id, file_id % 2 = 1 AS selected FROM (SELECT DISTINCT file_id FROM v_cells)")
def _(t):
    """The sheets that an instruction names as a whole word."""
    sheets = t.cells.select("file_id").distinct().withColumn("name", F.concat(F.lit("sheet "), F.col("file_id").cast("string")))
    said = F.when(F.col("file_id") % 2 == 1, F.concat(F.lit("read "), "name", F.lit(" only"))).otherwise("read others")
    return sheets.select("file_id", F.concat(F.lit(" "), said, F.lit(" ")).contains(F.concat(F.lit(" "), "name", F.lit(" "))).alias("selected"))


@query("g18_dash_clocks", """
WITH c AS (SELECT file_id, col_no, row_no, CASE WHEN col_no % 2 = 0 THEN CAST(8 + row_no % 9 AS VARCHAR) || '-30' ELSE '9-30' END AS text FROM v_cells), k AS (SELECT file_id, col_no, count(DISTINCT text) >= 2 AS ok FROM c GROUP BY 1, 2)
SELECT c.file_id, c.row_no, c.col_no, CASE WHEN ok THEN replace(text, '-', ':') ELSE text END AS text FROM c JOIN k ON k.file_id = c.file_id AND k.col_no = c.col_no""")
def _(t):
    cells = t.cells.select(*grid.CELL, F.when(F.col("col_no") % 2 == 0, F.concat((8 + F.col("row_no") % 9).cast("string"), F.lit("-30"))).otherwise("9-30").alias("text"))
    pattern = r"^([01]?[0-9]|2[0-3])-([0-5][0-9])$"
    clocked = cells.groupBy("file_id", "col_no").agg((F.countDistinct(F.when(F.col("text").rlike(pattern), F.col("text"))) >= 2).alias("ok"))
    return cells.join(clocked, ["file_id", "col_no"]).select(*grid.CELL, F.when(F.col("ok"), F.regexp_replace("text", pattern, "$1:$2")).otherwise(F.col("text")).alias("text"))


@query("g1_date_formulas", """
SELECT p_partkey // 10 AS file_id, p_partkey % 10 AS cell, CASE WHEN p_partkey // 10 % 5 = 4 AND p_partkey % 10 > 6 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(p_partkey // 10 % 28 AS INT) + CAST(7 * (p_partkey % 10) AS INT) AS DATE) END AS day FROM part""")
def _(t):
    """Each cell is the one before plus a week; in every fifth file the last three refer to each other."""
    c = t.part.select(F.expr("p_partkey div 10").alias("file_id"), (F.col("p_partkey") % 10).alias("cell"))
    loop = (F.col("file_id") % 5 == 4) & (F.col("cell") > 6)
    day = F.when(F.col("cell") == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("file_id") % 28).cast("int")))
    ref = F.when(loop, F.when(F.col("cell") == 7, 9).otherwise(F.col("cell") - 1)).when(F.col("cell") > 0, F.col("cell") - 1)
    return grid.resolved_dates(c.select("file_id", "cell", day.alias("day"), ref.alias("ref"), F.lit(7).alias("plus")), 16)


@query("g1_workbook_formulas", """
WITH c AS (SELECT p_partkey // 12 AS f, CAST(p_partkey % 12 AS INTEGER) AS r FROM part), m AS (SELECT f, min(r) AS r0 FROM c GROUP BY f)
SELECT CAST(f AS VARCHAR) || '.xlsx' AS file_name, r + 1 AS row_no, CASE WHEN r0 > 0 OR (f % 5 = 4 AND r > 8) OR r = 7 AND f % 3 = 1 THEN NULL WHEN r > 7 AND f % 3 = 1 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(f % 28 AS INTEGER) + 7 * r AS DATE) END AS day FROM c JOIN m USING (f)""")
def _(t):
    """Workbooks written, read and calculated: a date, then each cell from the one above, in several spellings.

    In every fifth file the last three lead around in a cycle, in every third one a formula is none of dates; a file
    whose first cell isn't there has no dates at all.
    """
    c = t.part.select(F.expr("p_partkey div 12").alias("f"), (F.col("p_partkey") % 12).cast("int").alias("r"))
    above, loop = F.col("r").cast("string"), (F.col("f") % 5 == 4) & (F.col("r") > 8)
    spelled = F.element_at(F.array(F.concat(F.lit("A"), above, F.lit("+7")), F.concat(F.lit("= $A$"), above, F.lit(" + 10 - 3")), F.concat(F.lit("7+a"), above)), F.col("r") % 3 + 1)
    first = F.concat(F.lit("DATE(2023,12,31)+"), (1 + F.col("f") % 28).cast("string"))
    formula = F.when(F.col("r") == 0, first).when(loop, F.when(F.col("r") == 9, "A12+7").otherwise(spelled)).when((F.col("f") % 3 == 1) & (F.col("r") == 7), F.concat(F.lit("SUM(A1:A"), above, F.lit(")"))).otherwise(spelled)
    cells = c.select("f", (F.col("r") + 1).alias("row_no"), F.lit(1).alias("col_no"), F.lit(None).cast("string").alias("text"), formula.alias("formula"))
    parts = files.workbook_parts(files.workbooks(cells, "f"))
    return grid.formula_dates(parts.filter("kind IN ('number', 'text')"), ["file_name", "sheet"], 16).select("file_name", "row_no", "day")


@query("s4_merged_cells", """
SELECT CAST(p_partkey // 12 AS VARCHAR) || '.xlsx' AS file_name, CAST(p_partkey % 12 + 1 AS INTEGER) AS row_no, c.c AS col_no, p_name AS text FROM part, (SELECT unnest([1, 2, 3]) AS c) c WHERE c.c = 1 OR p_partkey % 2 = 0""")
def _(t):
    """Names merged over three columns in every second row, as a workbook has them, filled into all cells that they cover."""
    wide = F.col("p_partkey") % 2 == 0
    row = (F.col("p_partkey") % 12 + 1).cast("int")
    cells = t.part.select(F.expr("p_partkey div 12").alias("f"), row.alias("row_no"), F.lit(1).alias("col_no"), F.col("p_name").alias("text"), F.when(wide, row).alias("last_row"), F.when(wide, 3).alias("last_col"))
    parts = files.workbook_parts(files.workbooks(cells, "f")).withColumn("file_id", F.struct("file_name", "sheet"))
    found = parts.filter("kind = 'merge'").select("file_id", F.col("row_no").alias("r1"), F.col("col_no").alias("c1"), F.col("last_row").alias("r2"), F.col("last_col").alias("c2"))
    return grid.filled(parts.filter("kind = 'text'").select(*grid.CELL, "text"), found).select("file_id.file_name", "row_no", "col_no", "text")


#: A timetable for each ten parts: two programmes of two groups each, lectures that a programme shares, days down and weeks beside.
def timetables(t):
    c = t.part.select(F.expr("p_partkey div 10").alias("file_id"), (F.col("p_partkey") % 10).cast("int").alias("i"), "p_name")
    file = c.select("file_id").distinct()
    number = (1_000_000 + F.col("file_id")).cast("string")  # not that of a group
    code = lambda j: F.concat(F.lit("GR"), number, F.lit(f"-{j}0{j}"))
    heads = [(1, 1, F.lit("Timetable")), (2, 4, F.concat(F.lit("Area"), number)), (2, 6, F.lit("Other studies")), (3, 1, F.lit("День")), (3, 2, F.lit("Неделя")), (3, 3, F.lit("Время"))]
    heads += [(3, 3 + j, code(j)) for j in range(1, 5)]
    axes = [(4 + 2 * i, 1, F.lit(name)) for i, name in enumerate(("Понедельник", "Вторник", "Среда", "Четверг", "Пятница"))]
    axes += [(r, 2, F.lit("I" if r % 2 == 0 else "II")) for r in range(4, 14)] + [(r, 3, F.lit(f"{r + 4}:15")) for r in range(4, 14)]
    fixed = file.select("file_id", F.explode(F.array(*(F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), x.alias("text")) for r, c, x in heads + axes))).alias("x")).select("file_id", "x.*")
    # a part's name stands in a group's column; where its number divides by three, over both groups of the first programme
    shared = F.col("i") % 3 == 0
    column = F.when(shared, 4).otherwise(4 + F.col("i") % 4)
    classes = c.select("file_id", (4 + F.col("i")).alias("row_no"), column.cast("int").alias("col_no"), F.col("p_name").alias("text"), shared.alias("shared"))
    cells = fixed.unionByName(classes.drop("shared"))
    m = lambda df, r1, c1, r2, c2: df.select("file_id", r1.cast("int").alias("r1"), c1.cast("int").alias("c1"), r2.cast("int").alias("r2"), c2.cast("int").alias("c2"))
    merges = m(file, F.lit(2), F.lit(4), F.lit(2), F.lit(5)).unionByName(m(file, F.lit(2), F.lit(6), F.lit(2), F.lit(7)))
    merges = merges.unionByName(m(classes.filter("shared"), F.col("row_no"), F.lit(4), F.col("row_no"), F.lit(5)))
    merges = merges.unionByName(m(file.withColumn("r", F.explode(F.array(*map(F.lit, range(4, 14, 2))))), F.col("r"), F.lit(1), F.col("r") + 1, F.lit(1)))
    return cells, merges


def requests(t):
    """By turns: a group's code, its number alone with its programme, the programme alone, and something else."""
    f = (1_000_000 + F.col("file_id")).cast("string")
    asked = F.element_at(F.array(F.concat(F.lit("please GR"), f, F.lit("-202")), F.concat(F.lit("area"), f, F.lit(": 101")), F.concat(F.lit("all of area"), f), F.lit("everything")), (F.col("file_id") % 4 + 1).cast("int"))
    return t.part.select(F.expr("p_partkey div 10").alias("file_id")).distinct().select("file_id", asked.alias("request"))


#: The classes of the timetables, with the last column that each covers.
CLASSES = "c AS (SELECT p_partkey // 10 AS file_id, CAST(4 + p_partkey % 10 AS INTEGER) AS row_no, CAST(CASE WHEN p_partkey % 10 % 3 = 0 THEN 4 ELSE 4 + p_partkey % 10 % 4 END AS INTEGER) AS col_no, CASE WHEN p_partkey % 10 % 3 = 0 THEN 5 END AS wide FROM part), f AS (SELECT DISTINCT file_id FROM c)"


@query("g5_weekday_axes", f"""
WITH {CLASSES} SELECT file_id, row_no, col_no, CAST((row_no - 4) // 2 AS INTEGER) AS weekday FROM c
UNION ALL SELECT file_id, r, k, CAST((r - 4) // 2 AS INTEGER) FROM f, (SELECT CAST(unnest(range(4, 14)) AS INTEGER) AS r), (SELECT unnest([2, 3]) AS k)""")
def _(t):
    return sheets.weekday_hints(*timetables(t))


@query("g6_week_column", f"""
WITH {CLASSES} SELECT file_id, row_no, col_no, CASE WHEN row_no % 2 = 0 THEN 'odd' ELSE 'even' END AS week FROM c
UNION ALL SELECT file_id, r, 3, CASE WHEN r % 2 = 0 THEN 'odd' ELSE 'even' END FROM f, (SELECT CAST(unnest(range(4, 14)) AS INTEGER) AS r)
UNION ALL SELECT file_id, r, 1, 'every' FROM f, (SELECT CAST(unnest(range(4, 14, 2)) AS INTEGER) AS r)""")
def _(t):
    return sheets.parity_hints(*timetables(t))


@query("g8_projection", f"""
WITH {CLASSES}, a AS (SELECT file_id, file_id % 4 AS q FROM f)
SELECT c.file_id, row_no, col_no FROM c JOIN a USING (file_id) WHERE q = 3 OR EXISTS (SELECT 1 FROM (SELECT unnest([4, 5]) AS s) WHERE s BETWEEN col_no AND coalesce(wide, col_no) AND (q = 2 OR s = 5 - q))
UNION ALL SELECT file_id, r, k FROM a, (SELECT CAST(unnest(range(4, 14)) AS INTEGER) AS r), (SELECT unnest([2, 3]) AS k)
UNION ALL SELECT file_id, r, 1 FROM a, (SELECT CAST(unnest(range(4, 14, 2)) AS INTEGER) AS r)""")
def _(t):
    """The data cells that are left of each timetable by its request."""
    rows = sheets.marked(*timetables(t))
    columns = sheets.selected_columns(sheets.matched(rows, requests(t)))
    return sheets.projected(rows, columns).filter("row_no > 3")


@query("g9_subgroups", f"""
WITH {CLASSES} SELECT file_id, 'GR' || (1000000 + file_id) || '-101,GR' || (1000000 + file_id) || '-202' AS choices FROM c WHERE file_id % 4 = 2 AND wide IS NULL AND col_no IN (4, 5) GROUP BY file_id""")
def _(t):
    rows, asked = sheets.marked(*timetables(t)), requests(t)
    found = sheets.questions(rows, asked, sheets.selected_columns(sheets.matched(rows, asked)))
    return found.select("file_id", F.array_join("choices", ",").alias("choices"))


@query("a9_top_labels", "SELECT label, n FROM (SELECT lower(p_type) AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(p_type)) AS rn FROM part GROUP BY 1) WHERE rn <= 16")
def _(t):
    return t.part.groupBy(F.lower("p_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(16)


@query("a9_first_spelling", """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS spelled FROM part)
SELECT arg_min(spelled, p_partkey) AS label, count(*) AS n FROM s GROUP BY lower(spelled) ORDER BY n DESC, lower(label) LIMIT 16""")
def _(t):
    """The most frequent labels, whatever their case, as they are spelled where they come first."""
    spelled = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("spelled"))
    found = spelled.groupBy(F.lower("spelled").alias("key")).agg(F.min_by("spelled", "p_partkey").alias("label"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "key").limit(16).select("label", "n")


@query("l6_candidate_caps", "SELECT l_partkey, l_orderkey, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 8")
def _(t):
    rn = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_discount"), "l_shipdate", "l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("rn", rn).filter("rn <= 8").select("l_partkey", "l_orderkey", "l_linenumber", "rn")


@query("w12_chunks")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return grid.chunked(lines, "doc_id", "line_no", 9000)


@query("w12_row_chunks", """
WITH RECURSIVE r AS (SELECT file_id, row_no, sum(length(text) + 24) AS chars, count(*) AS n, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS i FROM v_cells GROUP BY file_id, row_no),
  c AS (SELECT file_id, row_no, i, chars, n, 0 AS chunk FROM r WHERE i = 1
    UNION ALL SELECT r.file_id, r.row_no, r.i, CASE WHEN c.chars + r.chars > 900 OR c.n + r.n > 48 THEN r.chars ELSE c.chars + r.chars END, CASE WHEN c.chars + r.chars > 900 OR c.n + r.n > 48 THEN r.n ELSE c.n + r.n END,
      c.chunk + CASE WHEN c.chars + r.chars > 900 OR c.n + r.n > 48 THEN 1 ELSE 0 END FROM c JOIN r ON r.file_id = c.file_id AND r.i = c.i + 1)
SELECT file_id, row_no, chunk FROM c""")
def _(t):
    """Rows of sheets in chunks of 900 characters and 48 cells at most."""
    return grid.row_chunks(t.cells, 900)


@query("w12_document_chunks")
def _(t):
    """Documents of every hundred ids as one text, each a section with its source as the header; the greedy fold is tested against brute force."""
    mark = F.concat(F.lit("=== "), F.col("source"), F.lit(" ==="))
    lines = t.documents.select(F.floor(F.col("doc_id") / 100).alias("file_id"), "doc_id", F.posexplode(F.concat(F.array(mark), F.split("text", "\n"))).alias("n", "text"))
    lines = lines.select("file_id", (F.col("doc_id") * 1000000 + F.col("n")).alias("line_no"), "text")
    return grid.document_chunks(lines, "file_id", "line_no").select("file_id", "chunk", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("w14_reading_order", """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_quantity, l_extendedprice, l_partkey) AS text FROM lineitem GROUP BY l_orderkey""")
def _(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("x"), "l_partkey"))).alias("lines"))
    return lines.select("l_orderkey", F.array_join(F.transform("lines", lambda r: r["l_partkey"].cast("string")), " ").alias("text"))
