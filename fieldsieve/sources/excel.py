"""Sheets of .xlsx workbooks, read from the ZIP archive's XML; the files come through Spark's reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldsieve.functions.nulls import qcol

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


@contextmanager
def open_book(source: str | bytes) -> Iterator[zipfile.ZipFile]:
    """The archive of a workbook, by URI in any store that Arrow opens, or from its bytes."""
    if isinstance(source, bytes):
        yield zipfile.ZipFile(io.BytesIO(source))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(source)
    with store.open_input_file(path) as file, zipfile.ZipFile(file) as book:
        yield book


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """The name of each sheet and its part of the archive."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): links[s.get(LINK)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    return {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in sheets.items()}


def sheet_names_of(data: bytes) -> list[str]:
    with open_book(data) as book:
        return list(sheet_parts(book))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _pulled(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one after another; what has been passed is forgotten."""
    with book.open(part) as f:
        events = ElementTree.iterparse(f, events=("start", "end"))
        _, root = next(events)
        above: list[ElementTree.Element] = [root]
        for event, element in events:
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == f"{MAIN}{tag}":
                yield element
                above[-1].clear()


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows a date or time."""
    out: list[bool] = []
    if "xl/styles.xml" in book.namelist():
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{MAIN}numFmt")}
        for group in styles.iter(f"{MAIN}cellXfs"):
            for x in group:
                code = int(x.get("numFmtId") or 0)
                out.append(code in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(code, "")), re.I)))
    return out


def rows_of(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str | float | datetime | bool | None]]:
    """The rows of a sheet, one after another: text, numbers, dates, truth values, or None."""
    sheets = sheet_parts(book)
    if sheet not in sheets:
        raise ValueError(f"the workbook has no sheet {sheet}; it has {', '.join(sheets)}")
    shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in _pulled(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    dated, done = _dated(book), 0
    for row in _pulled(book, sheets[sheet], "row"):
        for _ in range(done, int(row.get("r") or done + 1) - 1):
            yield []
        done = int(row.get("r") or done + 1)
        cells: list = []
        for c in row.iter(f"{MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.get("t"), c.find(f"{MAIN}v")
            raw = value.text if value is not None else None
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif raw is None or kind == "e":
                continue
            elif kind == "s":
                cells[at] = shared[int(raw)]
            elif kind == "b":
                cells[at] = raw == "1"
            elif kind == "str":
                cells[at] = raw
            elif dated and dated[int(c.get("s") or 0)]:
                cells[at] = datetime(1899, 12, 30) + timedelta(days=float(raw))
            else:
                cells[at] = float(raw)
        yield cells


def cells_of(data: bytes, sheet: str) -> list[list[str | float | datetime | bool | None]]:
    """All rows of a sheet."""
    with open_book(data) as book:
        return list(rows_of(book, sheet))


def header_of(cells: list) -> list[str]:
    """Column names; one without a name is called by its place."""
    return [str(_text(h) or f"...{i + 1}") for i, h in enumerate(cells)]


def _text(value) -> str | None:
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d" if value.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else repr(value) if isinstance(value, float) else value


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None and v != ""}
    return {frozenset([float]): "double", frozenset([datetime]): "timestamp_ntz", frozenset([bool]): "boolean"}.get(frozenset(kinds), "string")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet) of the workbooks under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s) for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for s in sheet_names_of(c.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "sheet"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string")


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: T.StructType | None = None) -> DataFrame:
    """One sheet of the workbook at path, with `rowid`, its 1-based row number below the header.

    Without a schema the header and types come from the file, which is then read once on the
    driver (a workbook holds at most 2^20 rows). With one, workbooks are read in tasks, so path
    may match many files.
    """
    source = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        found = source.limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{path} is not one workbook: state a schema, or use read_workbooks()")
        rows = cells_of(bytes(found[0][0]), sheet)
        header = header_of(rows[0]) if rows else []
        kinds = [_kind([r[i] if i < len(r) else None for r in rows[1:]]) for i in range(len(header))]
    else:
        header = [f.name for f in schema]
        kinds = [f.dataType.simpleString() for f in schema]
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField("rowid", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                table = cells_of(content.as_py(), sheet)[1:]
                columns = [pa.array([_text(r[i]) if i < len(r) else None for r in table], pa.string()) for i in range(len(header))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(1, len(table) + 1), pa.int64())], [f.name for f in text])

    raw = source.mapInArrow(run, text)
    typed = [(F.col(f"c{i}") if k == "string" else F.col(f"c{i}").try_cast(k)).alias(h) for i, (h, k) in enumerate(zip(header, kinds, strict=True))]
    return raw.select(*typed, "rowid").where(~_nothing(header)) if header else raw


def load_workbook(spark: SparkSession, path: str, table: str, sheet: str, ids: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """From a workbook's sheet to the table of this id: typed, cleaned, renamed, with its lineage column."""
    from fieldsieve.operators.ingest import load

    return load(read_sheet(spark, path, sheet), table, path, ids, classes)


def _nothing(header: list[str]):
    """Rows without any cell, as trailing blank rows of a sheet are."""
    out = F.lit(True)
    for h in header:
        out = out & qcol(h).isNull()
    return out
