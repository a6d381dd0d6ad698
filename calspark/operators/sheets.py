"""Sheets with axes: which rows and columns hold days and times, what they say of each cell, and the part that a request names.

A cell is (file_id, row_no, col_no, text), a merged rectangle (file_id, r1, c1, r2, c2). All of it is joins and windows by file and
row or column; only the rows and columns of rectangles are opened, which a sheet bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions import text as T

from .grid import CELL, islands
from .saved import saved

HEADER_ROWS, FALLBACK, LABEL_CHARS = 12, 3, 40


def spanned(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the last row and column that they are merged over."""
    ends = merges.select("file_id", F.col("r1").alias("row_no"), F.col("c1").alias("col_no"), "r2", "c2")
    rows = cells.select(*CELL, "text").join(ends, CELL, "left")
    return rows.select(*CELL, "text", F.coalesce("r2", "row_no").alias("last_row"), F.coalesce("c2", "col_no").alias("last_col"))


def _axes(labels: DataFrame, line: str) -> DataFrame:
    """Lines (rows or columns) of weekday labels that are an axis: two days at least, as many different ones as the most frequent is often."""
    days = labels.groupBy("file_id", line, "day").agg(F.count(F.lit(1)).alias("n"))
    lines = days.groupBy("file_id", line).agg(F.count(F.lit(1)).alias("days"), F.max("n").alias("most"), F.sum("n").alias("labels"))
    return lines.filter("days >= 2 AND days >= most AND labels >= 2").select("file_id", line)


def weekday_hints(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The weekday of each cell, by days across a row above it or, first, by days down a column beside it (the rightmost of several).

    A day across labels the columns that it is merged over, down to the next row of days; a day down a column labels the
    rows that it is merged over or, by itself, those down to the next day.
    """
    whole = spanned(cells, merges)
    labels = whole.withColumn("day", T.weekday_name(F.col("text"))).filter("day IS NOT NULL")
    last = cells.groupBy("file_id").agg(F.max("row_no").alias("end_row"))
    # across: the nearest row of days above each row, whatever its columns
    across = labels.join(_axes(labels, "row_no"), ["file_id", "row_no"], "left_semi")
    heads = across.select("file_id", "row_no", F.col("row_no").alias("head")).distinct()
    rows = cells.select("file_id", "row_no").distinct().join(heads, ["file_id", "row_no"], "left")
    above = Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.last("head", ignorenulls=True).over(above)).filter("head IS NOT NULL")
    heads = across.select("file_id", F.col("row_no").alias("head"), F.explode(F.sequence("col_no", "last_col")).alias("col_no"), F.col("day").alias("across"))
    found = cells.select(*CELL).join(rows, ["file_id", "row_no"], "left").join(heads.dropDuplicates(["file_id", "head", "col_no"]), ["file_id", "head", "col_no"], "left")
    # down: blocks of rows, one hint for each column of days
    down = labels.join(_axes(labels, "col_no"), ["file_id", "col_no"], "left_semi").join(last, "file_id")
    following = F.lead("row_no").over(Window.partitionBy("file_id", "col_no").orderBy("row_no")) - 1
    down = down.withColumn("following", F.coalesce(following, "end_row"))
    down = down.withColumn("bottom", F.when(F.col("last_row") > F.col("row_no"), F.col("last_row")).when(F.col("last_col") > F.col("col_no"), F.col("row_no")).otherwise(F.col("following")))
    beside = down.select("file_id", F.col("col_no").alias("axis"), "day", F.explode(F.sequence("row_no", F.greatest("bottom", "row_no"))).alias("row_no"))
    beside = beside.groupBy("file_id", "row_no").agg(F.sort_array(F.collect_set(F.struct("axis", "day")), asc=False).alias("beside"))
    found = found.join(beside, ["file_id", "row_no"], "left")
    own = F.get(F.filter("beside", lambda b: b["axis"] != F.col("col_no")), F.lit(0))["day"]
    return found.select(*CELL, F.coalesce(own, "across").alias("weekday")).filter("weekday IS NOT NULL")


def parity_hints(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """odd, even or every for cells beside a column headed by a word for weeks, if it marks weeks of both kinds."""
    columns = cells.filter(T.is_week_header(F.col("text"))).select("file_id", "col_no").distinct()
    marks = cells.join(columns, ["file_id", "col_no"], "left_semi").select("file_id", "row_no", T.week_parity(F.col("text")).alias("week")).filter("week IS NOT NULL")
    both = marks.groupBy("file_id").agg(F.countDistinct("week").alias("n")).filter("n = 2").select("file_id")
    marks = marks.join(both, "file_id", "left_semi").groupBy("file_id", "row_no").agg(F.max("week").alias("week"))
    rows = spanned(cells, merges).join(columns, ["file_id", "col_no"], "left_anti").select(*CELL, F.explode(F.sequence("row_no", "last_row")).alias("covered"))
    rows = rows.join(marks.withColumnRenamed("row_no", "covered"), ["file_id", "covered"])
    return rows.groupBy(*CELL).agg(F.when(F.countDistinct("week") == 1, F.max("week")).otherwise("every").alias("week"))


def marked(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Spanned cells with header (their row is above the data), label (the text belongs to an axis) and axis (their column does).

    What follows joins them to themselves many times, so they are saved; each text is looked at once, and a file's cells are shuffled once.
    """
    rows = spanned(cells, merges).withColumns({"label": T.is_axis_label(F.col("text")), "timed": T.is_time_label(F.col("text")), "day": T.weekday_name(F.col("text"))})
    file, line = Window.partitionBy("file_id"), Window.partitionBy("file_id", "row_no")
    rows = rows.withColumn("i", F.dense_rank().over(file.orderBy("row_no")))
    one_day = F.min("day").over(line) == F.max("day").over(line)
    rows = rows.withColumn("data", F.when((F.col("i") <= HEADER_ROWS) & (F.max("timed").over(line) | one_day), F.col("i")))
    rows = rows.withColumn("header", F.col("i") < F.coalesce(F.min("data").over(file), F.lit(FALLBACK + 1))).drop("i", "data")
    column = Window.partitionBy("file_id", "col_no")
    below = F.coalesce(F.bool_and(F.when(~F.col("header"), F.col("label"))).over(column), F.lit(False))
    headed = F.max(F.col("header") & T.is_axis_header(F.col("text"))).over(column)
    return saved(rows.withColumn("axis", below | headed))


def matched(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Labels of the header that a request (file_id, request) names: whole, or by a code or number that no other label has."""
    labels = rows.filter(F.col("header") & ~F.col("axis") & (F.length("text") <= LABEL_CHARS)).select(*CELL, "text", "last_col", T.codes(F.col("text")).alias("codes"))
    labels = labels.join(requests.select("file_id", T.codes(F.col("request")).alias("said")), "file_id")
    whole = labels.filter(T.mentioned(F.col("codes"), F.col("said")))
    parts = F.array_distinct(F.concat(F.filter("codes", lambda c: c.rlike("[0-9]")), F.flatten(F.transform("codes", lambda c: F.regexp_extract_all(c, F.lit("([0-9]{2,})"), F.lit(1))))))
    each = labels.withColumn("part", F.explode(parts)).filter(F.length("part") >= 2)
    each = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id", "part"))).filter("n = 1")
    each = each.filter(F.array_contains("said", F.col("part")))
    columns = [*CELL, "text", "last_col"]
    return whole.select(*columns).unionByName(each.select(*columns)).distinct()


def selected_columns(found: DataFrame) -> DataFrame:
    """The columns under matched labels: those that all rows of labels have in common or, if there are none, those of the lowest row."""
    columns = found.select("file_id", "row_no", F.explode(F.sequence("col_no", "last_col")).alias("col_no")).distinct()
    file = Window.partitionBy("file_id")
    columns = columns.withColumn("levels", F.size(F.collect_set("row_no").over(file))).withColumn("lowest", F.max("row_no").over(file))
    columns = columns.groupBy("file_id", "col_no").agg(F.count(F.lit(1)).alias("n"), F.first("levels").alias("levels"), F.max(F.col("row_no") == F.col("lowest")).alias("low"))
    columns = columns.withColumn("common", F.max(F.col("n") == F.col("levels")).over(file))
    return saved(columns.filter(F.when(F.col("common"), F.col("n") == F.col("levels")).otherwise(F.col("low"))).select("file_id", "col_no"))


def _under(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The cells that cover a column, with how many, once each."""
    each = rows.select(*CELL, F.explode(F.sequence("col_no", "last_col")).alias("covered"))
    return each.join(columns.select("file_id", F.col("col_no").alias("covered")), ["file_id", "covered"]).groupBy(*CELL).agg(F.count(F.lit(1)).alias("covers"))


def questions(rows: DataFrame, requests: DataFrame, columns: DataFrame) -> DataFrame:
    """file_id and choices: groups inside what was asked for that have classes of their own, where none of them was named."""
    said = requests.select("file_id", T.codes(F.col("request")).alias("said"))
    labels = rows.filter(F.col("header")).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("file_id", "row_no", "text")))
    parts = labels.filter(~F.col("axis") & (F.length("text") <= LABEL_CHARS) & F.col("text").rlike("[0-9]") & (F.col("same") == 1)).join(_under(rows, columns), CELL)
    level = parts.groupBy("file_id", "row_no").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("file_id").agg(F.max("row_no").alias("row_no"))
    parts = parts.join(level, ["file_id", "row_no"], "left_semi").join(said, "file_id")
    groups = parts.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda p: p["text"]).alias("choices"), F.max(T.mentioned(T.codes(F.col("text")), F.col("said"))).alias("named"),
        F.min("col_no").alias("first_col"), F.max("last_col").alias("end_col"))
    own = rows.filter(~F.col("header") & ~F.col("label")).join(_under(rows, columns), CELL, "left_semi").join(groups.filter(~F.col("named")), "file_id")
    apart = own.filter((F.col("col_no") > F.col("first_col")) | (F.col("last_col") < F.col("end_col")))
    return apart.select("file_id", "choices").distinct()


def axis_blocks(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The axis columns to keep beside selected ones: the nearest block of them to the left, else to the right, and the nearest with times."""
    first = columns.groupBy("file_id").agg(F.min("col_no").alias("first"))
    axes = rows.filter("axis").groupBy("file_id", "col_no").agg(F.max(F.size(T.clocks(F.col("text"))) > 0).alias("timed"))
    blocks = islands(axes.join(columns, ["file_id", "col_no"], "left_anti").select("file_id", "col_no"))
    inside = axes.join(blocks, "file_id").filter(F.col("col_no").between(F.col("first_col"), F.col("last_col")))
    blocks = inside.groupBy("file_id", "first_col", "last_col").agg(F.max("timed").alias("timed")).join(first, "file_id")
    far = F.when(F.col("last_col") < F.col("first"), F.col("first") - F.col("last_col")).otherwise(F.col("first_col") - F.col("first") + 10_000)
    order = Window.partitionBy("file_id").orderBy(far, "first_col")
    blocks = blocks.withColumn("place", F.row_number().over(order))
    blocks = blocks.withColumn("near_timed", F.min(F.when(F.col("timed"), F.col("place"))).over(Window.partitionBy("file_id")))
    kept = blocks.filter((F.col("place") == 1) | (F.col("place") == F.col("near_timed")))
    return kept.select("file_id", F.explode(F.sequence("first_col", "last_col")).alias("col_no"))


def projected(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The cells of what was selected: those over its columns, and those of its axes; all cells of files where nothing was."""
    axes = axis_blocks(rows, columns).unionByName(rows.filter("axis").select("file_id", "col_no").join(columns, ["file_id", "col_no"], "left_semi")).distinct()
    over = _under(rows, columns).select(*CELL)
    beside = rows.join(axes, ["file_id", "col_no"], "left_semi").select(*CELL)
    others = rows.join(columns, "file_id", "left_anti").select(*CELL)
    return over.unionByName(beside).unionByName(others).distinct()
