"""Sheets as long tables of cells: headers, hints, blocks and slots, for many files at once.

A cell is (file_id, row_no, col_no, text); merged rectangles are (file_id, r1, c1, r2, c2).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from calspark.functions import text as T

from .folds import folded
from .saved import saved

CELL = ["file_id", "row_no", "col_no"]


def filled(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged rectangle with the value of its first one; rectangles are opened, so the join is on equal keys."""
    places = merges.select("file_id", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row_no"), "c2").select("file_id", "r1", "c1", "row_no", F.explode(F.sequence("c1", "c2")).alias("col_no"))
    origin = cells.select("file_id", F.col("row_no").alias("r1"), F.col("col_no").alias("c1"), F.col("text").alias("origin_text"))
    covered = places.join(origin, ["file_id", "r1", "c1"]).select(*CELL, "origin_text")
    return cells.join(covered, CELL, "full_outer").select(*CELL, F.coalesce("origin_text", "text").alias("text"))


def header_rows(cells: DataFrame) -> DataFrame:
    """Rows with two dates at least and one other label at most."""
    dates = F.count_if(T.is_pure_date(F.col("text")))
    return cells.groupBy("file_id", "row_no").agg(dates.alias("n_dates"), (F.count(F.lit(1)) - dates).alias("n_labels")).filter("n_dates >= 2 AND n_labels <= 1")


def date_hints(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """For each cell the date of the nearest header row above in its column."""
    marked = cells.join(headers.select("file_id", "row_no", F.lit(True).alias("header")), ["file_id", "row_no"], "left")
    above = Window.partitionBy("file_id", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = F.when(F.col("header") & T.is_pure_date(F.col("text")), F.col("text"))
    return marked.withColumn("date_hint", F.last(day, ignorenulls=True).over(above)).filter("header IS NULL").select(*CELL, "text", F.to_date("date_hint").alias("date_hint"))


def carried(cells: DataFrame, label: F.Column, name: str) -> DataFrame:
    """The last label of a column above each cell."""
    above = Window.partitionBy("file_id", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn(name, F.last(label, ignorenulls=True).over(above))


def extents(headers: DataFrame, last: DataFrame) -> DataFrame:
    """From each header row to the row before the next, or to the last row of its file."""
    following = F.lead("row_no").over(Window.partitionBy("file_id").orderBy("row_no"))
    return headers.withColumn("next_row", following).join(last, "file_id").select("file_id", F.col("row_no").alias("first_row"), F.coalesce(F.col("next_row") - 1, F.col("last_row")).alias("end_row"))


def header_extent(cells: DataFrame, most: int = 12, fallback: int = 3) -> DataFrame:
    """Rows before the first that holds a clock; ``fallback`` where there is none."""
    first = F.min(F.when(F.size(T.clocks(F.col("text"))) > 0, F.col("row_no")))
    return cells.groupBy("file_id").agg(F.least(F.coalesce(first - 1, F.lit(fallback)), F.lit(most)).alias("header_rows"))


def axis_columns(cells: DataFrame, test: F.Column) -> DataFrame:
    """Columns of which every cell passes the test."""
    return cells.groupBy("file_id", "col_no").agg(F.bool_and(test).alias("ok")).filter("ok").select("file_id", "col_no")


def islands(columns: DataFrame) -> DataFrame:
    """Columns side by side as blocks."""
    w = Window.partitionBy("file_id").orderBy("col_no")
    new = F.coalesce((F.col("col_no") - F.lag("col_no").over(w) > 1).cast("int"), F.lit(1))
    marked = columns.withColumn("new", new).withColumn("block", F.sum("new").over(w))
    return marked.groupBy("file_id", "block").agg(F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"))


def default_interval(start: F.Column, end: F.Column, deadline: F.Column) -> F.Column:
    """Minutes of the day: a deadline takes the half hour before it; without an end 90 minutes, to 23:59 at most."""
    begin = F.when(deadline, F.greatest(start - 30, F.lit(0))).otherwise(start)
    return F.struct(begin.alias("start_min"), F.when(deadline, start).otherwise(F.coalesce(end, F.least(start + 90, F.lit(1439)))).alias("end_min"))


def one_minute(clock: F.Column) -> F.Column:
    """A clock alone as an interval of a minute; the last minute of the day goes back."""
    late = clock >= 1439
    return F.struct(F.when(late, clock - 1).otherwise(clock).alias("start_min"), F.when(late, clock).otherwise(clock + 1).alias("end_min"))


def missed(cells: DataFrame, handled: DataFrame) -> DataFrame:
    """Cells with a clock that no slot was made of."""
    return cells.filter(F.size(T.clocks(F.col("text"))) > 0).join(handled.select(*CELL), CELL, "left_anti")


def verified(proposals: DataFrame, hints: DataFrame) -> DataFrame:
    """Proposals against the cell they name: a reason, or the slot with the date that the grid gives."""
    h = hints.select(*CELL, "text", "date_hint")
    rows = proposals.join(h, CELL, "left")
    known = F.array_contains(T.clocks(F.col("text")), F.col("start_min"))
    reason = F.when(F.col("text").isNull(), "cell").when(~F.lower("text").contains(F.lower("title")), "title").when(~known, "time").when(F.col("date_hint").isNull() & F.col("date").isNull(), "date")
    return rows.withColumns({"reason": reason, "day": F.coalesce("date_hint", "date")})


def resolved_dates(cells: DataFrame, most: int = 100) -> DataFrame:
    """Dates of cells that hold one or refer to another cell plus some days; chains up to ``most`` links, cycles stay without.

    ``cells`` has file_id, cell, day, ref and plus. Each round doubles the length of the links, so a chain of n takes log2(n).
    """
    rows, length = cells.select("file_id", "cell", "day", "ref", F.coalesce("plus", F.lit(0)).alias("plus")), 1
    while length < most:
        to = rows.select("file_id", F.col("cell").alias("ref"), F.col("day").alias("to_day"), F.col("ref").alias("to_ref"), F.col("plus").alias("to_plus"))
        joined = rows.join(to, ["file_id", "ref"], "left")
        day = F.coalesce("day", F.date_add("to_day", F.col("plus").cast("int")))
        open_ = F.when(day.isNull(), F.col("to_ref"))
        rows = joined.select("file_id", "cell", day.alias("day"), open_.alias("ref"), (F.col("plus") + F.coalesce("to_plus", F.lit(0))).alias("plus"))
        length *= 2
    return rows.select("file_id", "cell", "day")


TERM = r"([+-]?)(?:\$?([A-Z]{1,3})\$?([0-9]{1,7})|DATE\(([0-9]{4}),([0-9]{1,2}),([0-9]{1,2})\)|([0-9]{1,5}))"


def parsed_formula(formula: F.Column) -> F.Column:
    """day, ref_row, ref_col and plus of a sum of one date or one reference and days, in any order; null for anything else."""
    plain = F.regexp_replace(F.upper(formula), r"^\s*=|\s+", "")
    number = lambda x: F.try_to_number(F.nullif(x, F.lit("")), F.lit("9999999")).cast("int")

    def term(t: F.Column) -> F.Column:
        part = lambda i: F.regexp_extract(t, TERM, i)
        letters = F.split(part(2), "")
        column = F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
        return F.struct(
            (part(1) == "-").alias("minus"), number(part(3)).alias("row"), F.when(part(2) != "", column).alias("col"),
            F.try_to_date(F.nullif(F.concat_ws("-", part(4), part(5), part(6)), F.lit("--")), "yyyy-M-d").alias("day"), (part(4) != "").alias("dated"), number(part(7)).alias("days"),
        )

    def summed(terms: F.Column) -> F.Column:
        anchors = F.filter(terms, lambda t: t["row"].isNotNull() | t["dated"])
        plus = F.aggregate(terms, F.lit(0), lambda n, t: n + F.coalesce(F.when(t["minus"], -t["days"]).otherwise(t["days"]), F.lit(0)))
        one = F.get(anchors, F.lit(0))
        found = F.struct(one["day"].alias("day"), one["row"].alias("ref_row"), one["col"].alias("ref_col"), plus.alias("plus"))
        return F.when((F.size(anchors) == 1) & ~one["minus"] & (one["row"].isNotNull() | one["day"].isNotNull()), found)

    return F.when(plain.rlike(rf"^(?:{TERM})(?:(?=[+-]){TERM})*$"), T.let(F.transform(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), term), summed))


def formula_dates(cells: DataFrame, key: list[str], most: int = 100) -> DataFrame:
    """key, row_no, col_no and day of every cell that holds a date or a formula of dates; chains up to ``most`` links.

    ``cells`` has text and formula. Cells whose formula is none of ``parsed_formula``, or leads to no date, or around in a cycle, have no day.
    """
    at = lambda row, col: F.col(row).cast("long") * 65536 + F.col(col)
    rows = cells.select(*key, "row_no", "col_no", F.try_to_date("text", "yyyy-MM-dd").alias("own"), "formula", parsed_formula(F.col("formula")).alias("f")).filter("own IS NOT NULL OR formula IS NOT NULL")
    rows = rows.select(*key, "row_no", "col_no", F.struct(*key).alias("file_id"), at("row_no", "col_no").alias("cell"), "formula", "own", "f.*")
    day = F.when(F.col("formula").isNull(), F.col("own")).otherwise(F.date_add("day", F.col("plus")))
    rows = saved(rows)  # each round joins them to themselves, and they are not made again for it
    found = resolved_dates(rows.select("file_id", "cell", day.alias("day"), at("ref_row", "ref_col").alias("ref"), "plus"), most)
    return found.select(*(F.col(f"file_id.{k}").alias(k) for k in key), F.shiftright("cell", 16).cast("int").alias("row_no"), (F.col("cell") % 65536).cast("int").alias("col_no"), "day")


def chunked(lines: DataFrame, key: str, order: str, most_chars: int) -> DataFrame:
    """A chunk number for each line: a new chunk before a line that would exceed the size. A line without text counts as empty."""

    def placed(state: list, n: int) -> int:
        full = state[1] > 0 and state[1] + n > most_chars
        state[:] = [state[0] + full, n if full else state[1] + n]
        return state[0]

    rows = lines.select(key, F.col(order).cast("bigint").alias(order), F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    return folded(rows, [key], [order], ["n"], "chunk", lambda: [0, 0], placed).select(key, order, F.col("chunk").cast("int").alias("chunk"))


def row_chunks(cells: DataFrame, most_chars: int = 9000, most_cells: int = 48, place: int = 24) -> DataFrame:
    """file_id, row_no and chunk: a new chunk before a row that would exceed the characters or the cells of one.

    A cell counts its text and ``place`` characters for where it stands; a row is never cut, so one that is too large by itself is a chunk.
    """

    def placed(state: list, chars: int, n: int) -> int:
        full = state[2] > 0 and (state[1] + chars > most_chars or state[2] + n > most_cells)
        state[:] = [state[0] + full, chars if full else state[1] + chars, n if full else state[2] + n]
        return state[0]

    rows = cells.groupBy("file_id", "row_no").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)) + place).alias("chars"), F.count(F.lit(1)).alias("n"))
    return folded(rows, ["file_id"], ["row_no"], ["chars", "n"], "chunk", lambda: [0, 0, 0], placed).select("file_id", "row_no", F.col("chunk").cast("int").alias("chunk"))


#: A line that begins a section, one that is a row of a table, and how many rows and lines of a section are its header at most.
SECTION, ROW, HEADER_ROWS, HEADER_LINES = "=== ", re.compile(r"(?:T[0-9]+)?R[0-9]+\t"), 4, 12
BATCH_CHARS = 4_000_000


class _Joined:
    """Lines of a text, and the size it has without the blanks around it; blanks at its end are kept up to ``most`` characters only."""

    def __init__(self, lines: list[str]):
        self.lines, self.n, self.first, self.last = [], 0, None, 0
        for line in lines:
            self.add(line)

    def add(self, line: str, most: int | None = None) -> None:
        start, said = self.n + (self.n > 0 or bool(self.lines)), line.strip()
        if said:
            self.last = start + len(line.rstrip())
            self.first = start + len(line) - len(line.lstrip()) if self.first is None else self.first
        if said or most is None or self.n - self.last <= most:  # beyond, a further text begins a new chunk, so these blanks go
            self.lines.append(line)
        self.n = start + len(line)

    def size_with(self, line: str) -> int:
        if not line.strip():
            return self.last - (self.first or 0)
        start = self.n + (self.n > 0 or bool(self.lines))
        return start + len(line.rstrip()) - (start + len(line) - len(line.lstrip()) if self.first is None else self.first)

    def text(self) -> str:
        return "\n".join(self.lines).strip()


def _pieces(lines: Iterator[str], most: int) -> Iterator[str]:
    """Sections, in pieces that begin with the section's header where one is too long."""
    header, rows, now = [], 0, None
    for line in lines:
        if now is None or line.startswith(SECTION):
            if now is not None:
                yield now.text()
            header, rows, now = [], 0, _Joined([])
        if rows < HEADER_ROWS and len(header) < HEADER_LINES:
            header.append(line)
            rows += bool(ROW.match(line))
            now.add(line)
            continue
        if now.size_with(line) > most:
            yield now.text()
            now = _Joined(header)
        now.add(line, most)
    if now is not None:
        yield now.text()


def _packed(pieces: Iterator[str], most: int) -> Iterator[str]:
    held = ""
    for piece in filter(None, pieces):
        if held and len(held) + len(piece) + 1 > most:
            yield held
            held = ""
        held = f"{held}\n{piece}" if held else piece
    if held:
        yield held


def document_chunks(lines: DataFrame, key: str, order: str, most_chars: int = 9000) -> DataFrame:
    """key, chunk, n_chars and text: documents in chunks of ``most_chars`` that are cut between lines only.

    A section begins at a line with the mark of one. A section that fits is kept whole; a longer one is cut before the line
    that would exceed the size, and each of its chunks begins with the section's header. Chunks that follow each other are
    put together while they fit. Chunks are trimmed, empty ones go; a line without text counts as empty. A chunk is longer
    than ``most_chars`` only where a header and one line are.

    Texts are shuffled once: Spark sorts the lines of a partition, and spills, and Python holds a chunk, a header and a batch of
    what it gives back. What goes into a chunk depends on all lines before, so a document is the work of one task.
    """
    rows = lines.select(F.col(key).alias("_key"), F.col(order).cast("long").alias("_line"), F.coalesce("text", F.lit("")).alias("_text"))
    schema = StructType([StructField(key, rows.schema["_key"].dataType), StructField("chunk", IntegerType()), StructField("n_chars", IntegerType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out, size = [], 0
        for own, group in itertools.groupby(given, key=lambda r: r[0]):
            for i, text in enumerate(_packed(_pieces((r[1] for r in group), most_chars), most_chars)):
                out.append((own, i, len(text), text))
                size += len(text)
                if size > BATCH_CHARS:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    arrow = to_arrow_schema(schema)
    batch_of = lambda out: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)
    dealt = rows.repartition("_key").sortWithinPartitions("_key", "_line").select("_key", "_text")
    return dealt.mapInArrow(run, schema)


# Words of headers that are no title, and how the weeks of a row are told.
NO_TITLE = ("день", "дата", "время", "предмет", "дисциплина", "занятие", "пара", "группа")
ODD_STEMS, EVEN_STEMS = ("числител", "нечет"), ("знаменател", "чет")
#: What is no title, of a text in lower case: a word of a header, a day, a clock, a number, signs only, the code of a group.
OTHER = "|".join((
    rf"\A(?:{'|'.join(NO_TITLE)})\z", T.DAY_NAME.replace("е", "[её]"), T.CLOCK, r"\A[№#]?\s*[0-9]+[./-]?[0-9]*$", r"\A[^\p{L}0-9]*\z",
    r"(?=\p{L})(?U:(?<!\w)(?<!\w[-./‐-―−])\p{L}{2,6}[-‐-―−][0-9]{1,3}(?:[-‐-―−][0-9]{2})?(?!\w)(?![-./‐-―−]\w))",
))


def row_slots(cells: DataFrame) -> DataFrame:
    """file_id, row_no, weekday, start_min, end_min, title, week_pattern and resolved of each row that has a time, under a day.

    The day is the one that the row names, or that of the last row above that names exactly one. The first two clocks are the
    interval; one alone lasts 90 minutes. A row is resolved if exactly one of its texts is a title (no word of a header, day,
    time, number or code of a group) and it ends after it starts, on that day; else all but row, day and times are null.
    Thursday, which begins as the word for even does, tells no weeks.
    """
    own = cells.select(*CELL, F.trim("text").alias("text")).filter("text <> ''")
    own = own.select("file_id", "row_no", F.struct("col_no", "text", F.lower("text").rlike(OTHER).alias("other")).alias("cell"))
    row = own.groupBy("file_id", "row_no").agg(F.sort_array(F.collect_list("cell")).alias("own"))
    row = row.withColumn("text", F.array_join(F.col("own")["text"], "\t")).withColumn("days", T.weekdays_in(F.col("text")))
    above = Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = row.withColumn("weekday", F.last(F.when(F.size("days") == 1, F.get("days", F.lit(0))), ignorenulls=True).over(above))
    row = row.filter(F.col("weekday").isNotNull() & F.col("text").rlike(T.CLOCK))
    row = row.withColumn("clocks", F.regexp_extract_all("text", F.lit(T.CLOCK), F.lit(0)))
    titles = F.array_distinct(F.filter("own", lambda c: ~c["other"])["text"])
    minutes = lambda clock: F.regexp_extract(clock, "^[0-9]+", 0).cast("int") * 60 + F.right(clock, F.lit(2)).cast("int")
    start, end = (minutes(F.get("clocks", F.lit(i))) for i in (0, 1))
    row = row.select("file_id", "row_no", "weekday", start.alias("start_min"), F.coalesce(end, start + 90).alias("end_min"), titles.alias("titles"), F.translate(F.lower("text"), "ё", "е").alias("words"))
    letter, names = "[a-zа-я0-9]", "|".join(n for own in T.DAY_NAMES for n in own)
    begins = lambda stems: F.col("words").rlike(rf"(?=[{''.join(s[0] for s in stems)}])(?<!{letter})(?!(?:{names})(?!{letter}))(?:{'|'.join(stems)})")
    weeks = F.when(begins(ODD_STEMS), "odd").when(begins(EVEN_STEMS), "even").otherwise("every")
    good = (F.size("titles") == 1) & (F.col("end_min") > F.col("start_min")) & (F.col("end_min") < 1440)
    return row.select("file_id", "row_no", "weekday", "start_min", "end_min", F.when(good, F.left(F.get("titles", F.lit(0)), F.lit(255))).alias("title"), F.when(good, weeks).alias("week_pattern"), good.alias("resolved"))
