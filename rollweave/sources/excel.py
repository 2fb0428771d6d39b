"""Excel workbooks (.xlsx) as tables of strings, read by the standard library where the files' bytes are: no file reaches the driver.

A workbook is a zip archive of XML parts. One task reads one file, row by row; only headers meet at the driver, because they name the
columns. Numbers are written as Excel stores them (without a trailing ``.0``), dates and times in ISO form, booleans as True and False.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnClashError
from ..plans.session import find_package

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of dates and times that every workbook has without declaring them.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Literal text, colours and conditions of a declared format, which may hold letters of dates.
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def _text(element: ElementTree.Element) -> str:
    """Text of a string item, which may be cut into runs; phonetic hints aren't part of it."""
    return "".join(t.text or "" for child in element if child.tag != f"{_MAIN}rPh" for t in child.iter(f"{_MAIN}t"))


class Workbook:
    """One workbook's parts, and the rows of a sheet."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.parts = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        properties = book.find(f"{_MAIN}workbookPr")
        since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        self.zero = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): posixpath.normpath(posixpath.join("/xl", targets[s.get(_RELATION)])).lstrip("/") for s in book.iter(f"{_MAIN}sheet")}
        self.shared = [_text(s) for s in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.parts else []
        self.dated = self._dated_styles() if "xl/styles.xml" in self.parts else []

    def _xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def _dated_styles(self) -> list[bool]:
        """For each cell style whether it shows a number as a date or time."""
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", _QUOTED.sub("", f.get("formatCode", "")), re.I)}
        cells = styles.find(f"{_MAIN}cellXfs")
        return [int(x.get("numFmtId", 0)) in _DATES | own for x in (cells if cells is not None else ())]

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, inline, value = cell.get("t", "n"), cell.find(f"{_MAIN}is"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return _text(inline) if inline is not None else None
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        if kind == "b":
            return str(value.text == "1")
        if kind != "n":
            return value.text
        number, style = float(value.text), int(cell.get("s", 0))
        if style < len(self.dated) and self.dated[style]:
            return str(self.zero + timedelta(milliseconds=round(number * 86_400_000)))
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, sheet: str | int = 0) -> Iterator[list[str | None]]:
        """Rows that hold anything, from the first such row on; one is held at a time."""
        names = list(self.sheets)
        if isinstance(sheet, int) and not 0 <= sheet < len(names) or isinstance(sheet, str) and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {names}")
        with self.zip.open(self.sheets[names[sheet] if isinstance(sheet, int) else sheet]) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for at, cell in enumerate(row.iter(f"{_MAIN}c")):
                    place = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (place + 1 - len(out))
                    out[place] = self._value(cell)
                row.clear()
                if any(v not in (None, "") for v in out):
                    yield out


def _column(reference: str) -> int:
    """Number of a cell's column, from 0."""
    return reduce(lambda n, c: 26 * n + ord(c) - 64, (c for c in reference if c.isalpha()), 0) - 1


def _names(header: list[str | None], path: str) -> list[str]:
    names = [h if h not in (None, "") else f"Unnamed: {i}" for i, h in enumerate(header)]
    if len(set(names)) < len(names):
        raise ColumnClashError(f"columns of {path} that aren't unique: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def read_xlsx(spark: SparkSession, paths: list[str], sheet: str | int = 0) -> DataFrame:
    """All rows of one sheet of each workbook as strings, by column name; columns that a workbook lacks are null.

    The first row that holds anything is the header; rows without any value are left out.
    """
    if not paths:
        raise ValueError("no files to read")
    find_package(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = next(Workbook(content.as_py()).rows(sheet), [])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.list_(pa.string()))], ["path", "cells"])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for i, cells in enumerate(Workbook(content.as_py()).rows(sheet)):
                    if i:
                        held.append(cells)
                    if len(held) == 1000:
                        yield _batch(path, held)
                        held = []
                if held:
                    yield _batch(path, held)

    found = files.mapInArrow(headers, "path string, cells array<string>").collect()  # one row a file
    by_header: dict[tuple, list[str]] = {}
    for path, cells in sorted((r.path, r.cells) for r in found):
        by_header.setdefault(tuple(_names(cells, path)), []).append(path)
    frames = []
    for names, where in by_header.items():
        of = spark.read.format("binaryFile").load(where).select("path", "content").mapInArrow(lines, "path string, cells array<string>")
        frames.append(of.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _batch(path: str, rows: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(rows, pa.list_(pa.string()))], ["path", "cells"])
