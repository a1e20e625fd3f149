"""Fleets of xlsx workbooks as one table of cells.

A workbook is a bounded unit (the format ends at 1,048,576 rows per sheet), so one task parses one
file and a folder of workbooks spreads over the cluster. Numbers keep the text stored in the file.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInputError
from ..labels import DEFAULT_LABELS, Labels
from ..operators.lookup import lookup_join
from ..schemas import CELL_SCHEMA
from ..scratch import settled
from .numbers import running_starts

ROWS_AT_A_TIME = 10_000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
_DAY_ZERO = datetime(1899, 12, 30)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, archive member) in workbook order."""
    main = next(n for n in book.namelist() if n.endswith("workbook.xml"))
    folder, name = posixpath.split(main)
    links = ElementTree.fromstring(book.read(posixpath.join(folder, "_rels", name + ".rels")))
    target = {link.get("Id"): link.get("Target") for link in links}
    found = []
    for sheet in ElementTree.fromstring(book.read(main)).iter(_MAIN + "sheet"):
        member = target[sheet.get(_REL + "id")]
        member = member[1:] if member.startswith("/") else posixpath.normpath(posixpath.join(folder, member))
        found.append((sheet.get("name"), member))
    return found


def _part(book: zipfile.ZipFile, suffix: str):
    name = next((n for n in book.namelist() if n.endswith(suffix)), None)
    return None if name is None else ElementTree.fromstring(book.read(name))


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "sharedStrings.xml")
    if root is None:
        return []
    return [_rich_text(item) for item in root.iter(_MAIN + "si")]


def _rich_text(item) -> str:
    """Plain text or text runs; reading aids beside them are no part of the text."""
    own = item.findall(_MAIN + "t") + item.findall(f"{_MAIN}r/{_MAIN}t")
    return "".join(t.text or "" for t in own)


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    root = _part(book, "styles.xml")
    if root is None:
        return set()
    custom = {
        f.get("numFmtId")
        for f in root.iter(_MAIN + "numFmt")
        if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = root.find(_MAIN + "cellXfs")
    ids = [] if formats is None else [x.get("numFmtId", "0") for x in formats]
    return {str(i) for i, n in enumerate(ids) if n in custom or int(n) in _DATE_FORMATS}


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _cell_text(cell, shared: list[str], date_styles: set[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        inline = cell.find(_MAIN + "is")
        return "" if inline is None else _rich_text(inline)
    value = cell.findtext(_MAIN + "v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind is None and cell.get("s") in date_styles:
        moment = _DAY_ZERO + timedelta(seconds=round(float(value) * 86400))
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(" ")
    return value


def _sheet_rows(book, member, shared, date_styles) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    with book.open(member) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != _MAIN + "row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for cell in row.iter(_MAIN + "c"):
                at = _column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                cells.extend([None] * (at + 1 - len(cells)))
                cells[at] = _cell_text(cell, shared, date_styles)
            row.clear()
            yield number, cells


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                shared, dates = _shared_texts(book), _date_styles(book)
                for pos, (sheet, member) in enumerate(_sheets(book)):
                    rows = _sheet_rows(book, member, shared, dates)
                    while some := list(islice(rows, ROWS_AT_A_TIME)):
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([path] * n, pa.string()), pa.array([pos] * n, pa.int32()), pa.array([sheet] * n, pa.string()),
                                pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.list_(pa.string())),
                            ],
                            names=CELL_SCHEMA.names,
                        )


def _list_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                names = [(path, pos, name) for pos, (name, _) in enumerate(_sheets(book))]
            yield pd.DataFrame(names, columns=["path", "sheet_pos", "sheet"])


def workbook_cells(files: DataFrame) -> DataFrame:
    """All rows of all sheets: path, sheet_pos, sheet, row_idx (1-based), cells."""
    return files.select("path", "content").mapInArrow(_parse, CELL_SCHEMA)


def workbook_sheets(files: DataFrame) -> DataFrame:
    """Sheet names per workbook, in order."""
    return files.select("path", "content").mapInPandas(
        _list_sheets, "path string, sheet_pos int, sheet string"
    )


def pick_sheet(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of the named sheet, or of each workbook's first sheet."""
    return cells.filter(F.col("sheet") == sheet if sheet else F.col("sheet_pos") == 0)


def workbook_list(
    cells: DataFrame,
    columns: list[str] | None = None,
    sheet: str | None = None,
    labels: Labels = DEFAULT_LABELS,
    header_rows: int = 1,
) -> DataFrame:
    """One sheet per workbook as a list: named text columns, ``path`` and row numbers.

    Row 1 of every sheet is its header. Without ``columns`` each workbook's cells are placed by its own
    header, so workbooks may order their columns differently; the list has every name that occurs,
    in the order of first occurrence. Cells under a blank header are left out. With two ``header_rows`` the
    second one, which holds codes, gets number 0. Row numbers are dense over the fleet, in
    the order of paths, so that a number names one row.

    The fleet is parsed once: the chosen sheet's rows are written, and headers, row counts and the list
    itself are read from there.
    """
    chosen = settled(pick_sheet(cells, sheet).select("path", "row_idx", "cells"))
    headers = chosen.filter("row_idx = 1").select("path", F.col("cells").alias("header"))
    last = chosen.groupBy("path").agg(F.max("row_idx").alias("last"))
    counted = last.withColumn("__rows", F.greatest(F.col("last") - header_rows, F.lit(0)))
    files = running_starts(counted, ["path"], "__rows", "__start")
    if columns is None:
        layouts = headers.groupBy("header").agg(F.min("path").alias("first")).orderBy("first").collect()  # one row per layout
        columns = list(dict.fromkeys(name for r in layouts for name in r["header"] if name))
        if not columns:
            raise EmptyInputError("文件为空")
        places = F.array(*[F.array_position("header", name).cast("int") for name in columns])
        files = files.join(headers.select("path", places.alias("__places")), "path")
    else:
        files = files.withColumn("__places", F.array(*[F.lit(i + 1) for i in range(len(columns))]))
    table = files.select("path", "__start", "__places", F.col("last").alias("__last"))
    body = chosen.filter("row_idx > 1").withColumn("__file", F.col("path"))
    placed = lookup_join(body, table, F.col("path"), "path", F.col("row_idx"), key_rows="__last").filter("__places IS NOT NULL")
    values = [F.get("cells", F.nullif(F.get("__places", F.lit(i)), F.lit(0)) - 1).alias(name) for i, name in enumerate(columns)]
    number = F.when(F.col("row_idx") > header_rows, F.col("__start") + F.col("row_idx") - header_rows).otherwise(F.lit(0))
    return placed.select(*values, F.col("__file").alias("path"), number.cast("bigint").alias(labels.row_num))
