"""Workbooks (.xlsx) through Spark's binary file source: the zipped XML is read in Arrow tasks, a file in a task."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_BATCH = 4096


def _column(reference: str) -> int:
    """The place of a cell's column, from 0: of "BC12" it is that of "BC"."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, plain or in runs; phonetic guides are no part of it."""
    runs = [node, *node.iter(f"{_MAIN}r")]
    return "".join(t.text or "" for r in runs for t in r.findall(f"{_MAIN}t"))


class Workbook:
    """The first sheet of a workbook, row by row."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        root = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        sheet = root.find(f"{_MAIN}sheets/{_MAIN}sheet")
        target = links[sheet.get(f"{_LINKS}id")]
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        self.shared = [_text(si) for si in self._xml("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        properties = root.find(f"{_MAIN}workbookPr")
        self.first_day = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        shown = lambda code: re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())) is not None
        dated = _DATE_FORMATS | {i for i, code in own.items() if shown(code)}
        formats = styles.find(f"{_MAIN}cellXfs")
        return {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dated}

    def value(self, cell: ElementTree.Element) -> str:
        """A cell as text: whole numbers without a fraction, dates as ISO, errors and blanks empty."""
        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{_MAIN}is")
            return _text(inline) if inline is not None else ""
        text = v.text if v is not None and v.text is not None else ""
        if kind == "s":
            return self.shared[int(text)] if text else ""
        if kind == "b":
            return "True" if text == "1" else "False"
        if kind == "e":
            return ""
        if kind in ("str", "d") or not text:
            return text
        number = float(text)
        if int(cell.get("s", 0)) in self.dates:
            return (self.first_day + timedelta(milliseconds=round(number * 86_400_000))).strftime("%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number)

    def rows(self) -> Iterator[list[str]]:
        """All rows up to the last, in order; rows and cells that are left out are empty."""
        at = 0
        with self.zip.open(self.sheet) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_MAIN}row":
                    continue
                number = int(node.get("r", at + 1))
                for _ in range(at + 1, number):
                    yield []
                at, row = number, []
                for cell in node.findall(f"{_MAIN}c"):
                    k = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [""] * (k + 1 - len(row))
                    row[k] = self.value(cell)
                node.clear()
                yield row


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            held: list[list[str]] = []
            first = 0
            for row in Workbook(data).rows():
                held.append(row)
                if len(held) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["place", "cells"])
                    first, held = first + len(held), []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["place", "cells"])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook: the columns of its first row, all as text, blanks as "".

    A header that is blank is named by its place, and one that comes again by a number after it.  A sheet without rows
    has no columns.  What is no workbook is an error.
    """
    sheet = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cells, "place bigint, cells array<string>")
    header = sheet.where("place = 0").select("cells").first()
    names: list[str] = []
    for k, name in enumerate(header["cells"] if header else []):
        name = name or f"Unnamed: {k}"
        count = sum(n == name or n.rsplit(".", 1)[0] == name and n.rsplit(".", 1)[-1].isdigit() for n in names)
        names.append(f"{name}.{count}" if count else name)
    return sheet.where("place > 0").select(*(F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))
