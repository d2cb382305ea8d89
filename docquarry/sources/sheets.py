"""Spreadsheets: the cells of XLSX files as rows, read by tasks from any store that Spark reads."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import ship_package

# The namespaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

SCHEMA = "path string, sheet string, active boolean, row_no long, cells array<string>, problem string"
#: Rows of a batch that leaves a task.
ROWS = 4096

_PLACE = re.compile(r"([A-Z]+)(\d+)")


def column_number(letters: str) -> int:
    """The number of a column from 0: A is 0, AA is 26."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(element) -> str:
    """The text of a string item: its own or that of its runs, without phonetic hints."""
    own = [e.text or "" for e in element if e.tag == f"{_MAIN}t"]
    return "".join(own + [t.text or "" for r in element.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")])


def _rows(part, strings: list[str], columns: list[int] | None):
    """(row number, values) of a sheet as it streams by; only the columns that are asked for are turned into text."""
    at = 0
    for _, row in ElementTree.iterparse(part):
        if row.tag != f"{_MAIN}row":
            continue
        at = int(row.get("r", at + 1))
        values, place = {}, -1
        for cell in row.findall(f"{_MAIN}c"):
            named = _PLACE.fullmatch(cell.get("r", ""))
            place = column_number(named[1]) if named else place + 1
            if columns is not None and place not in columns:
                continue
            kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
            if kind == "inlineStr":
                inner = cell.find(f"{_MAIN}is")
                values[place] = None if inner is None else _text(inner)
            elif value is not None and value.text is not None:
                values[place] = strings[int(value.text)] if kind == "s" else None if kind == "e" else value.text
        row.clear()
        if values:
            asked = range(max(values) + 1) if columns is None else columns
            yield at, [values.get(c) for c in asked]


def sheets_of(content: bytes, columns: list[int] | None):
    """(sheet, active, row number, values) of all sheets of a file, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{_MAIN}si":
                        strings.append(_text(item))
                        item.clear()
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        targets = {e.get("Id"): posixpath.normpath(posixpath.join("/xl", e.get("Target"))).lstrip("/") for e in links}
        view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
        shown = int(view.get("activeTab", 0)) if view is not None else 0
        for k, sheet in enumerate(root.find(f"{_MAIN}sheets")):
            target = targets.get(sheet.get(f"{_REL}id"))
            if target in names:
                with book.open(target) as part:
                    for at, values in _rows(part, strings, columns):
                        yield sheet.get("name"), k == shown, at, values


def sheet_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(path, sheet, active, row_no, cells, problem): the rows of all sheets of XLSX files that hold something.

    cells are texts, as many as the row has, or those of the named columns only; numbers are as the file has them, error
    cells null. active says whether the file opens on the sheet. A file that can't be read gives one row with
    its problem and what was read before. A task opens whole files, which the format keeps to some
    million rows, and passes rows on as it reads them.
    """
    ship_package(spark)
    asked = None if columns is None else [column_number(c) for c in columns]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").option("recursiveFileLookup", True).load(path)

    def batch(rows):
        types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches):
        for given in batches:
            for path, content in zip(*(given.column(k).to_pylist() for k in (0, 1))):
                held = []
                try:
                    for row in sheets_of(content, asked):
                        held.append((path, *row, None))
                        if len(held) == ROWS:
                            yield batch(held)
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError) as e:
                    held.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if held:
                    yield batch(held)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _number(column: str) -> F.Column:
    return F.expr(f"try_cast(try_cast({column} as double) as long)")


def snippets(spark: SparkSession, path: str) -> DataFrame:
    """(path, snippet_id, text) from the third row of the sheet that a file opens on: columns C and F; of rows with one id
    the last counts."""
    rows = sheet_rows(spark, path, ["C", "F"]).where("active and row_no >= 3")
    rows = rows.select("path", "row_no", _number("cells[0]").alias("snippet_id"), F.expr("cells[1] text"))
    rows = rows.where("snippet_id is not null and text is not null")
    return rows.groupBy("path", "snippet_id").agg(F.trim(F.max_by("text", "row_no")).alias("text"))


def criteria(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, id, phase, group, text, binding, status, snippet_ids, chapter_structure) from the second row of the sheet that
    a file opens on: columns B to I; snippet_ids are the numbers between bars."""
    rows = sheet_rows(spark, path, list("BCDEFGHI")).where("active and row_no >= 2")
    said = lambda k: F.trim(F.coalesce(F.expr(f"cells[{k}]"), F.lit("")))
    names = {1: "phase", 2: "group", 3: "text", 4: "binding", 5: "status", 7: "chapter_structure"}
    marks = F.transform(F.regexp_extract_all(F.coalesce(F.expr("cells[6]"), F.lit("")), F.lit(r"\|(\d+)\|"), 1), lambda x: x.cast("long"))
    found = rows.select(
        "path", "row_no", _number("cells[0]").alias("id"), *(said(k).alias(n) for k, n in names.items()), marks.alias("snippet_ids")
    )
    return found.where("id is not null").select(
        "path", "row_no", "id", "phase", "group", "text", "binding", "status", "snippet_ids", "chapter_structure"
    )
