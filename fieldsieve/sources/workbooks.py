"""Many workbooks as one table: a data source of Spark with partitions by file and by ranges of rows.

    spark.dataSource.register(Workbooks)
    spark.read.format("workbook").schema(...).option("sheet", ...).option("files", ...).load()

`read_workbooks` finds the files, merges the headers and types of all of them in tasks, and reads them
by column name, so files may hold their columns in any order. A sheet's rows are pulled from the
archive one after another; a task holds one batch of them, never a whole tree.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldsieve.functions.nulls import qcol
from fieldsieve.sources.excel import _kind, _nothing, _text, header_of, open_book, rows_of, sheet_parts

#: Rows of a sheet that a partition takes, and that it holds at once.
PART, BATCH = 100_000, 10_000
#: Columns that are added: the row number below the header in its file, and the file's name.
ROWID, LINEAGE = "rowid", "input_filename"


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _extent(book: zipfile.ZipFile, part: str) -> int | None:
    """The last row that a sheet says it has; None if it does not say."""
    with book.open(part) as f:
        found = re.search(rb'<dimension[^>]*ref="[A-Z]+\d+:[A-Z]+(\d+)"', f.read(2000))
    return int(found[1]) if found else None


class Rows(InputPartition):
    """Rows first to last of a file below its header; last None: all that follow."""

    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class Workbooks(DataSource):
    """Options: files, a JSON list of paths; sheet; rows, how many a partition takes. All columns are text but `rowid`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        raise ValueError("state the schema, or use read_workbooks()")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["sheet"], json.loads(self.options["files"]), int(self.options.get("rows", PART)), schema)


class Reader(DataSourceReader):
    def __init__(self, sheet: str, files: list[list], rows: int, schema: T.StructType):
        self.sheet, self.files, self.rows, self.names = sheet, files, rows, [f.name for f in schema]

    def partitions(self) -> list[Rows]:
        out = []
        for path, extent in self.files:
            last = (extent or 1) - 1
            out += [Rows(path, first, first + self.rows - 1) for first in range(1, last - self.rows + 1, self.rows)]
            out.append(Rows(path, 1 + self.rows * max(0, -(-last // self.rows) - 1), None))
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        base = part.path.rsplit("/", 1)[-1]
        with open_book(_uri(part.path)) as book:
            rows = rows_of(book, self.sheet)
            at = {name: i for i, name in enumerate(header_of(next(rows, [])))}
            held: list[tuple] = []
            for number, cells in enumerate(rows, 1):
                if part.last is not None and number > part.last:
                    break
                if number >= part.first:
                    cell = lambda n: _text(cells[at[n]]) if n in at and at[n] < len(cells) else None  # noqa: B023, E731
                    held.append(tuple(number if n == ROWID else base if n == LINEAGE else cell(n) for n in self.names))
                if len(held) == BATCH:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == ROWID else pa.string()) for c, n in zip(columns, self.names, strict=True)], self.names)


def _headers(files: DataFrame, sheet: str) -> DataFrame:
    """(path, extent, at, name, kind) of each column of each file, read in tasks; kind is null where a column has no value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_book(_uri(path)) as book:
                    extent, rows = _extent(book, sheet_parts(book)[sheet]) if sheet in sheet_parts(book) else None, rows_of(book, sheet)
                    header = header_of(next(rows, []))
                    kinds: list[set[str]] = [set() for _ in header]
                    for cells in rows:
                        for kind, v in zip(kinds, cells, strict=False):
                            if v is not None and v != "":
                                kind.add(_kind([v]))
                found = [(path, extent, i, n, "string" if len(k) > 1 else next(iter(k), None)) for i, (n, k) in enumerate(zip(header, kinds, strict=True))]
                if found:
                    kinds_of = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds_of, strict=True)], ["path", "extent", "at", "name", "kind"])

    return files.mapInArrow(run, "path string, extent long, at int, name string, kind string")


def read_workbooks(spark: SparkSession, path: str, sheet: str, rows: int = PART) -> DataFrame:
    """The sheet of all workbooks that path matches as one table, with `rowid` and `input_filename`; rows without any cell are left out.

    A column of several files has their type, or text where they differ; a file without it has nulls.
    Columns stand as they first come, by file name and then place. A file without the sheet raises
    an error. Each file is read once to find types and once for its rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # contents are not read here
    parts = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    headers = _headers(files.repartition(parts, "path"), sheet).persist()  # a row for each column of each file
    try:
        merged = headers.groupBy("name").agg(F.min(F.struct("path", "at")).alias("first"), F.collect_set("kind").alias("kinds")).orderBy("first").collect()  # a row for each name
        extents = [[r["path"], r["extent"]] for r in headers.groupBy("path").agg(F.max("extent").alias("extent")).orderBy("path").collect()]  # a row for each file
    finally:
        headers.unpersist()
    names = [r["name"] for r in merged]
    if clash := {ROWID, LINEAGE} & set(names):
        raise ValueError("the workbooks have columns that are added: " + ", ".join(sorted(clash)))
    text = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(ROWID, T.LongType()), T.StructField(LINEAGE, T.StringType())])
    spark.dataSource.register(Workbooks)
    raw = spark.read.format("workbook").schema(text).option("sheet", sheet).option("files", json.dumps(extents)).option("rows", rows).load()
    kind = {r["name"]: r["kinds"][0] if len(r["kinds"]) == 1 else "string" for r in merged}
    typed = [(qcol(n) if kind[n] == "string" else qcol(n).try_cast(kind[n])).alias(n) for n in names]
    out = raw.select(*typed, ROWID, LINEAGE)
    return out.where(~_nothing(names)) if names else out


def load_workbooks(spark: SparkSession, path: str, table: str, sheet: str, ids: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """From the sheets of all workbooks that path matches to the table of this id, each row with the name of its own file."""
    from fieldsieve.operators.ingest import load

    return load(read_workbooks(spark, path, sheet), table, F.col(LINEAGE), ids, classes)
