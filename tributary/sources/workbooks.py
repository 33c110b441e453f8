"""Spreadsheet files (xlsx) as tables of cells: first sheet, text of each cell."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def first_sheet(data: bytes) -> list[list[str | None]]:
    """Rows of cells; missing rows and cells are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = "xl/worksheets/sheet1.xml"
        if "xl/workbook.xml" in parts and "xl/_rels/workbook.xml.rels" in parts:
            first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            target = targets[first.get(_LINK)]
            sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        tree = ElementTree.fromstring(z.read(sheet))
    rows: list[list[str | None]] = []
    for row in tree.iter(f"{_MAIN}row"):
        at = int(row.get("r", len(rows) + 1))
        rows += [[] for _ in range(at - len(rows))]
        for cell in row.iter(f"{_MAIN}c"):
            column = len(rows[at - 1])
            if letters := re.match("[A-Z]+", cell.get("r", "")):
                column = 0
                for c in letters[0]:
                    column = column * 26 + ord(c) - 64
                column -= 1
            value = cell.find(f"{_MAIN}v")
            text = value.text if value is not None else None
            if cell.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            rows[at - 1] += [None] * (column + 1 - len(rows[at - 1]))
            rows[at - 1][column] = text
    return rows


# The parts of a workbook that names its only sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet: numbers as numbers, the rest as text, None as no cell."""

    def letters(c: int) -> str:
        return (letters(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)

    def cell(r: int, c: int, value) -> str:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{letters(c)}{r}"><v>{value!r}</v></c>'
        return f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows, 1))
    sheet = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**_PARTS, "xl/worksheets/sheet1.xml": sheet}.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): (path, row, cells) with rows from 0, and files that are no workbook."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = first_sheet(data)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, IndexError, ValueError) as e:
                    yield pd.DataFrame({"path": [name], "row": [-1], "cells": [[type(e).__name__]]})
                    continue
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pd.DataFrame({"path": name, "row": range(at, at + len(part)), "cells": part})

    rows = files.mapInPandas(work, "path string, row int, cells array<string>")
    rejects = rows.where("row < 0").select("path", F.concat(F.lit("no workbook: "), F.col("cells")[0]).alias("reason"))
    return rows.where("row >= 0"), rejects


def addressed(cells: DataFrame, **places: tuple[int, int]) -> DataFrame:
    """(path, a column for each place): values at (row, column), counted from 0."""
    return cells.groupBy("path").agg(*(F.max(F.when(F.col("row") == r, F.get("cells", F.lit(c)))).alias(name) for name, (r, c) in places.items()))


def series(cells: DataFrame, first_row: int, **columns: int) -> DataFrame:
    """(path, row, a column for each position) from ``first_row`` on."""
    return cells.where(F.col("row") >= first_row).select("path", "row", *(F.get("cells", F.lit(c)).alias(name) for name, c in columns.items()))
