"""Excel (.xlsx) exports as a Spark job over many workbooks.

``binaryFile`` lists the workbooks; ``mapInPandas`` opens each one with the
standard library (an .xlsx is a zip of XML parts) and emits its first sheet
row by row. A workbook is the unit of work, so many workbooks spread over the
cluster; the cell text stays a string, as in the CSV path.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    first = wb.find("m:sheets/m:sheet", _NS)
    rid = first.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels:
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


# FIXED VALUES: built-in number formats that show dates or times
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_FORMAT_TEXT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
    dates = _DATE_FORMATS | {i for i, code in own.items() if re.search("[ymdhs]", _FORMAT_TEXT.sub("", code), re.I)}
    return {n for n, xf in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(xf.get("numFmtId", 0)) in dates}


def serial_text(value: str, epoch_1904: bool) -> str:
    """Text of a date cell (``yyyy-MM-dd HH:mm:ss``, to the microsecond if it has a fraction)."""
    days = float(value)
    # the 1900 system counts a 29 February that never was
    base = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30 if days >= 60 else 31)
    at = base + dt.timedelta(milliseconds=round(days * 86_400_000))
    return str(at)


def _cell_text(c: ET.Element, shared: list[str], dates: set[int], epoch_1904: bool) -> str | None:
    kind, v = c.get("t"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind in (None, "n") and int(c.get("s", 0)) in dates:
        return serial_text(v.text, epoch_1904)
    return v.text


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, row by row; the sheet's XML is streamed, not held as a tree."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        properties = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
        epoch_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        dates = _date_styles(z)
        with z.open(_first_sheet_path(z)) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", _NS):
                    ref = _CELL_REF.match(c.get("r", ""))
                    cells[_col_index(ref.group(1)) if ref else len(cells)] = _cell_text(c, shared, dates, epoch_1904)
                yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]
                row.clear()


CHUNK_ROWS = 5000


def _explode_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["_file", "_row", "cells"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = sheet_rows(bytes(content))
            header = [h or "" for h in next(rows, [])]
            out = []
            for n, r in enumerate(rows):
                out.append((path, n, {h: (r[i] if i < len(r) else None) for i, h in enumerate(header) if h}))
                if len(out) >= CHUNK_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per sheet row: ``cells`` keyed by the workbook's own header names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_explode_workbooks, "_file string, _row long, cells map<string,string>")
