"""Spreadsheet files as cells: a Python data source that reads xlsx bytes with the standard library alone.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("path", folder).load()

One task reads one file; a file is the unit, as its zip directory and shared strings belong together.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row_no int, cells array<string>"
_EPOCH = datetime(1899, 12, 30)
# Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
_NS = re.compile(r"^\{[^}]*\}")


def _tag(e) -> str:
    return _NS.sub("", e.tag)


def _children(e, name: str) -> list:
    return [c for c in e if _tag(c) == name]


def _text(e) -> str:
    """All text runs below an element, phonetic hints left out."""
    if _tag(e) == "rPh":
        return ""
    return (e.text or "" if _tag(e) == "t" else "") + "".join(_text(c) for c in e)


def serial_text(x: float) -> str:
    """A date cell: times of day (before 1910) as HH:MM with midnight blank, other days as dd.MM.yyyy."""
    t = _EPOCH + timedelta(milliseconds=round(x * 86_400_000))
    if t.year < 1910:
        return "" if (t.hour, t.minute) == (0, 0) else f"{t:%H:%M}"
    return f"{t:%d.%m.%Y}"


def number_text(x: float) -> str:
    """A plain number: fractions of a day as HH:MM, whole numbers without a point."""
    if 0 < x < 1:
        m = int(x * 24 * 60)
        return f"{m // 60:02d}:{m % 60:02d}"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def column_index(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def read_workbook(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, physical row, cells) of every row that holds a cell; gaps are blank cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda p: ElementTree.fromstring(z.read(p))
        shared = [_text(si) for si in _children(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {}
            for f in (f for fs in _children(styles, "numFmts") for f in fs):
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
                own[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code, re.I))
            for x in (x for xs in _children(styles, "cellXfs") for x in xs):
                k = int(x.get("numFmtId", 0))
                dated.append(own.get(k, k in _DATE_FORMATS))
        rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in (s for ss in _children(xml("xl/workbook.xml"), "sheets") for s in ss):
            target = rels[next(v for k, v in sheet.attrib.items() if _NS.sub("", k) == "id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            for data_ in _children(xml(path), "sheetData"):
                for n, row in enumerate(_children(data_, "row"), 1):
                    cells: list[str] = []
                    for c in _children(row, "c"):
                        at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [""] * (at - len(cells) + 1)
                        cells[at] = _cell(c, shared, dated)
                    if any(cells):
                        yield sheet.get("name"), int(row.get("r", n)), cells


def _cell(c, shared: list[str], dated: list[bool]) -> str:
    kind, values = c.get("t", "n"), _children(c, "v")
    if kind == "inlineStr":
        return "".join(_text(i) for i in _children(c, "is"))
    v = values[0].text if values and values[0].text is not None else ""
    if kind == "s":
        return shared[int(v)] if v else ""
    if kind != "n" or not v:
        return v.strip()
    style = int(c.get("s", 0))
    x = float(v)
    return serial_text(x) if style < len(dated) and dated[style] else number_text(x)


def write_workbook(sheets: dict[str, list[list[str | float]]]) -> bytes:
    """A small xlsx of inline strings and numbers, for tests and exports."""
    from xml.sax.saxutils import escape, quoteattr

    def ref(j: int) -> str:
        s = ""
        j += 1
        while j:
            j, r = divmod(j - 1, 26)
            s = chr(65 + r) + s
        return s

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = [(f"rId{k}", name) for k, name in enumerate(sheets, 1)]
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(f"<sheet name={quoteattr(n)} sheetId='{k}' r:id='{i}'/>" for k, (i, n) in enumerate(ids, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id='{i}' Target='worksheets/sheet{k}.xml'/>" for k, (i, _) in enumerate(ids, 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = ""
            for n, row in enumerate(rows, 1):
                cells = "".join(
                    f"<c r='{ref(j)}{n}' t='inlineStr'><is><t xml:space='preserve'>{escape(v)}</t></is></c>" if isinstance(v, str) else f"<c r='{ref(j)}{n}'><v>{v!r}</v></c>"
                    for j, v in enumerate(row) if v not in ("", None)
                )
                body += f"<row r='{n}'>{cells}</row>" if cells else ""
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path)
        files = [root] if root.is_file() else sorted(p for p in root.rglob("*.xlsx") if not p.name.startswith("~"))
        return [_File(str(p)) for p in files]

    def read(self, partition: _File):
        name = Path(partition.path).name
        for sheet, row, cells in read_workbook(Path(partition.path).read_bytes()):
            yield name, sheet, row, cells


class WorkbookSource(DataSource):
    """xlsx files below a path all executors see, one row a sheet row."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def cells_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cells of workbooks already loaded as bytes (spark.read.format('binaryFile')): works on every file system.

    A file that is no workbook gives one row with its name, no sheet and the error as its only cell, so one bad
    file never fails a run; null content likewise.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf[path], pdf[content]):
                name = posixpath.basename(p)
                try:
                    rows += [(name, s, n, c) for s, n, c in read_workbook(bytes(data))]
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, [f"{type(e).__name__}: {e}"]))
            yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"]).astype({"row_no": "Int32"})

    return files.select(path, content).mapInPandas(run, SCHEMA)


def failed_files(cells: DataFrame) -> DataFrame:
    return cells.where("sheet IS NULL").select("file", F.get("cells", F.lit(0)).alias("error"))
