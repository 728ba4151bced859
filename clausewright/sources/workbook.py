"""Workbooks (xlsx) to rows of text, and rows to a workbook: zipped XML, of which a sheet's cells are read.

Files come by Spark's reader, so from any store; a workbook has about a million rows at most and is one task's.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the format gives its parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _number(reference: str) -> int:
    """The column of a cell, A being 0."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(element) -> str:
    """All text of an element's runs; what says how to pronounce it is left out."""
    return "".join(t.text or "" for run in ([element] if element.find(f"{MAIN}r") is None else element.findall(f"{MAIN}r")) for t in run.findall(f"{MAIN}t"))


def _part_of(book: zipfile.ZipFile, sheet: int | str) -> str:
    """Where in the file a sheet is, by its name or its place from 0."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    chosen = [s for k, s in enumerate(sheets) if sheet in (k, s.get("name"))]
    if not chosen:
        raise ValueError(f"no sheet {sheet!r}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[chosen[0].get(f"{{{LINKS}}}id")]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def read(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, cells as text: shared and inline strings, numbers as they are written, truth values as TRUE and FALSE; null where a cell is empty or missing."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        last = 0
        with book.open(_part_of(book, sheet)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r") or last + 1)
                yield from ([] for _ in range(number - last - 1))  # rows without cells needn't be written
                last, cells = number, []
                for cell in row.findall(f"{MAIN}c"):
                    at = _number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
                    if kind == "inlineStr":
                        value = _texts(cell.find(f"{MAIN}is"))
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                    cells.append(value or None)
                yield cells
                row.clear()


def write(rows: list[list[str | None]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet, all cells text."""

    def cell(r: int, c: int, value: str) -> str:
        letters, n = "", c + 1
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(65 + k) + letters
        return f'<c r="{letters}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows, 1))
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, text in parts.items():
            book.writestr(path, text)
    return out.getvalue()


def cells(books: DataFrame, sheet: int | str = 0) -> DataFrame:
    """books: path, content. path, row (from 1, the header being 0), cells: a map from header to text, of the cells that aren't empty. Rows without any are left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = read(content, sheet)
                header = next(rows, [])
                held = [(n, [(h, v) for h, v in zip(header, row, strict=False) if h is not None and v is not None]) for n, row in enumerate(rows, 1)]
                held = [(n, m) for n, m in held if m]
                yield pa.record_batch({"path": pa.array([path] * len(held), pa.string()), "row": pa.array([n for n, _ in held], pa.int64()), "cells": pa.array([m for _, m in held], pa.map_(pa.string(), pa.string()))})

    return books.select("path", "content").mapInArrow(apply, "path string, row long, cells map<string,string>")


def sheet(spark: SparkSession, path: str, name: int | str = 0) -> DataFrame:
    """target_name, cik, extra of a workbook's sheet with a header, as files.sheet has them of a CSV."""
    rows = cells(spark.read.format("binaryFile").load(path), name)
    others = F.map_filter("cells", lambda k, _: ~k.isin("Target Name", "CIK Number"))
    return rows.select(F.try_element_at("cells", F.lit("Target Name")).alias("target_name"), F.try_element_at("cells", F.lit("CIK Number")).alias("cik"), others.alias("extra"))
