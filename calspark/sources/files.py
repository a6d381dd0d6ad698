"""Files as rows of bytes: format by content, archives, delimited texts, workbooks."""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendars import dealt, decoded

MOST_MEMBERS, MOST_BYTES, BATCH_BYTES, BATCH_ROWS = 20, 20_000_000, 4_000_000, 20_000
MEMBERS = "file_name string, member string, content binary, reject string"
CELLS = "file_name string, sheet string, row_no int, col_no int, kind string, text string, formula string, last_row int, last_col int"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def file_kind(content: Column, name: Column) -> Column:
    """The format by the first bytes, by the extension where they don't tell."""
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    office = F.when(extension.isin("xlsx", "docx", "ods"), extension).otherwise("zip")
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), office).when(head.startswith("D0CF11E0A1B11AE1"), "xls")
        .when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(F.instr(F.hex(F.substring(content, 1, 512)), "00") % 2 == 1, "binary")
        .when(F.substring(content, 1, 15).cast("string").startswith("BEGIN:VCALENDAR"), "ics").otherwise(F.when(extension == "", "txt").otherwise(extension))
    )


#: What unreadable zip members, XML and references raise.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, KeyError, IndexError, ValueError, RuntimeError, NotImplementedError, ElementTree.ParseError)


def _content(archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """The bytes of a member, or the reason why there are none: it is corrupt, encrypted, or packed in an unknown way."""
    try:
        return archive.read(member), None
    except UNREADABLE:
        return None, "corrupt"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``members``, given back as soon as they have BATCH_BYTES: what is unpacked of a batch of archives is never held whole."""
    arrow = pa.schema([pa.field("file_name", pa.string()), pa.field("member", pa.string()), pa.field("content", pa.binary()), pa.field("reject", pa.string())])
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
    rows, size = [], 0
    for batch in batches:
        for name, content in zip(*batch.columns, strict=True):  # an archive at a time becomes bytes
            name = name.as_py()
            try:
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
            except zipfile.BadZipFile:
                rows.append((name, None, None, "broken"))
                continue
            own = [x for x in archive.infolist() if not x.is_dir() and not x.filename.startswith("__MACOSX/")]
            large = sum(x.file_size for x in own[:MOST_MEMBERS]) > MOST_BYTES
            for i, x in enumerate(own):
                why = "bytes" if large else "members" if i >= MOST_MEMBERS else None
                rows.append((name, x.filename, *((None, why) if why else _content(archive, x))))
                size += len(rows[-1][2] or b"")
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
    if rows:
        yield batch_of(rows)


def members(files: DataFrame) -> DataFrame:
    """file_name, member and content of the files in each archive; a broken archive is one row with the reason in reject.

    Members beyond MOST_MEMBERS, or all of an archive over MOST_BYTES, have no content and the reason in reject.
    """

    return files.select("file_name", "content").mapInArrow(_members, MEMBERS)


def archived(files: DataFrame, key: str, most_bytes: int = MOST_BYTES, most_members: int = MOST_MEMBERS) -> DataFrame:
    """Archives for each key, of its files (member, content): the sink beside ``members``, whose caps no archive exceeds.

    The first is named key.zip, the others key.part.zip; only a file that is too large by itself makes one over the cap.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in sorted(zip(group["member"], group["content"], strict=True)):
                archive.writestr(zipfile.ZipInfo(name), content)
        part = group["part"].iloc[0]
        return pd.DataFrame({"file_name": [f"{group[key].iloc[0]}{'' if part == '0-0-0' else f'.{part}'}.zip"], "content": [out.getvalue()]})

    rows = dealt(files, key, ["member", "content"], F.octet_length("content"), most_bytes, most_members)
    return rows.groupBy(key, "part").applyInPandas(run, "file_name string, content binary")


def delimited(files: DataFrame) -> DataFrame:
    """Cells of delimited texts; the delimiter is that of , ; tab | which a file has most, outside quotes.

    A field in quotes may hold delimiters, line ends and doubled quotes; a quote that is never closed is an ordinary letter.
    """
    text = F.regexp_replace(decoded(F.col("content")), r"\r\n?", "\n")
    bare = F.regexp_replace("text", r"\"[^\"]*\"", "")
    counted = F.array(*(F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate((",", ";", "\t", "|"))))
    rows = files.select("file_name", text.alias("text")).withColumn("d", F.array_max(counted)["d"])
    # a line ends, or a field, where no quoted field is open: quotes up to there come in pairs
    lines = F.regexp_extract_all(F.regexp_replace("text", r"\n+$", ""), F.lit(r"(?s)((?:\"(?:[^\"]|\"\")*\"|[^\n])*)(?:\n|$)"), F.lit(1))
    lines = rows.select("file_name", "d", F.posexplode(lines).alias("row_no", "line"))
    field = F.concat(F.lit(r'(?s)(?:^|\Q'), "d", F.lit(r'\E)(\s*\"(?:[^\"]|\"\")*\"\s*(?=\Q'), "d", F.lit(r'\E|$)|(?:(?!\Q'), "d", F.lit(r'\E).)*)'))
    cells = lines.select("file_name", (F.col("row_no") + 1).alias("row_no"), F.posexplode(F.regexp_extract_all("line", field, F.lit(1))).alias("col_no", "text"))
    quoted = F.trim("text").rlike(r'(?s)^\".*\"$') & (F.length(F.trim("text")) > 1)
    cells = cells.withColumn("text", F.when(quoted, F.replace(F.regexp_extract(F.trim("text"), r'(?s)^\"(.*)\"$', 1), F.lit('""'), F.lit('"'))).otherwise(F.col("text")))
    return cells.select("file_name", "row_no", (F.col("col_no") + 1).alias("col_no"), F.trim("text").alias("text")).filter("text <> ''")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    """The name of a column: A to Z, AA and so on."""
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def _place(ref: str) -> tuple[int, int]:
    """Row and column of A1."""
    return int(re.search(r"[0-9]+", ref)[0]), _column(ref)


def _xml(archive: zipfile.ZipFile, name: str):
    """A member as a stream of XML; one that declares types or entities of its own is refused."""
    with archive.open(name) as start:
        if re.search(rb"<!(?:DOCTYPE|ENTITY)", start.read(4096), re.IGNORECASE):
            raise ValueError("a document type of its own")
    return archive.open(name)


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name and member of each visible sheet, by the relations of the workbook."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in archive.namelist():
        for r in ElementTree.parse(_xml(archive, "xl/_rels/workbook.xml.rels")).getroot():
            targets[r.get("Id")] = posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))).lstrip("/")
    for i, s in enumerate(ElementTree.parse(_xml(archive, "xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"), 1):
        if s.get("state", "visible") == "visible":
            yield s.get("name"), targets.get(s.get(RELATION), f"xl/worksheets/sheet{i}.xml")


def _sheet_rows(archive: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple]:
    """row_no, col_no, kind, text, formula, last_row and last_col of the cells and merged rectangles of a sheet."""
    for _, x in ElementTree.iterparse(_xml(archive, member)):
        if x.tag == f"{MAIN}mergeCell":
            first, _, last = x.get("ref").partition(":")
            yield *_place(first), "merge", None, None, *_place(last or first)
        if x.tag != f"{MAIN}c":
            continue
        kind, value, formula = x.get("t", "n"), x.findtext(f"{MAIN}v"), x.findtext(f"{MAIN}f")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in x.iter(f"{MAIN}t"))
        if kind == "e":
            value = None
        if value is not None or formula:
            text = shared[int(value)] if kind == "s" and value is not None else value
            yield *_place(x.get("r")), "number" if kind == "n" else "text", text, formula or None, None, None
        x.clear()


def workbook_parts(files: DataFrame) -> DataFrame:
    """Cells (with their formulas, as written) and merged rectangles (kind "merge", to last_row and last_col) of visible sheets.

    Error cells have no text. The XML is read from zip members as it streams by; a file that is no
    workbook, or of which any part can't be read, is one row of kind "broken", for quarantine.
    """

    names = [c.split()[0] for c in CELLS.split(", ")]
    arrow = pa.schema([pa.field(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in CELLS.split(", ")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    shared = []
                    if "xl/sharedStrings.xml" in archive.namelist():
                        shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.parse(_xml(archive, "xl/sharedStrings.xml")).getroot()]
                    own = [(name, sheet, *row) for sheet, member in _sheets(archive) for row in list(_sheet_rows(archive, member, shared))]
                except (*UNREADABLE, TypeError, AttributeError):
                    own = [(name, None, None, None, "broken", None, None, None, None)]
                rows += own
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select("file_name", "content").mapInArrow(run, CELLS)


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells with text of the visible sheets of workbooks, and a row of kind "broken" for what is none."""
    return workbook_parts(files).filter("kind = 'broken' OR (kind <> 'merge' AND text IS NOT NULL)").select("file_name", "sheet", "row_no", "col_no", "kind", "text")


def workbooks(cells: DataFrame, key: str) -> DataFrame:
    """A workbook of one sheet for each key, from its cells: the sink beside ``workbook_parts``.

    A column formula (null for none) is written beside the text; last_row and last_col, where they are not null, merge the
    rectangle that begins at the cell.
    """
    from xml.sax.saxutils import escape, quoteattr

    main, relations = MAIN[1:-1], RELATION[1:-3]
    fixed = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="{relations}/worksheet" Target="worksheets/cells.xml"/></Relationships>',
    }

    def made(group: Iterator[tuple]) -> bytes:
        lines, merged = [], []
        for row_no, own in itertools.groupby(group, key=lambda r: r[1]):
            lines.append(f'<row r="{row_no}">')
            for _, _, c, text, formula, to_row, to_col in own:
                place = f"{_letters(c)}{row_no}"
                if to_row is not None:
                    merged.append(f"{place}:{_letters(to_col)}{to_row}")
                if formula is not None:
                    lines.append(f'<c r="{place}"><f>{escape(formula)}</f></c>')
                elif text is not None:
                    lines.append(f'<c r="{place}" t="inlineStr"><is><t>{escape(text)}</t></is></c>')
            lines.append("</row>")
        merges = f'<mergeCells>{"".join(f"<mergeCell ref={quoteattr(m)}/>" for m in merged)}</mergeCells>' if merged else ""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in fixed.items():
                archive.writestr(zipfile.ZipInfo(name), content)
            archive.writestr(zipfile.ZipInfo("xl/worksheets/cells.xml"), f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData>{merges}</worksheet>', zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        names, contents, size = [], [], 0
        for name, group in itertools.groupby(rows, key=lambda r: r[0]):
            names.append(f"{name}.xlsx")
            contents.append(made(group))
            size += len(contents[-1])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_name", "content"])
                names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_name", "content"])

    optional = [F.col(c) if c in cells.columns else F.lit(None).cast(t).alias(c) for c, t in (("formula", "string"), ("last_row", "int"), ("last_col", "int"))]
    # a workbook's cells come one after the other, so many small ones cost no call each
    placed = cells.filter("row_no IS NOT NULL").select(key, "row_no", "col_no", "text", *optional).repartition(key).sortWithinPartitions(key, "row_no", "col_no")
    return placed.mapInArrow(run, "file_name string, content binary")
