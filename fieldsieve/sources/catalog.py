"""A catalog of tables as three CSV files: an index, relations between tables, and column types."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldsieve.sources.scratch import written
from fieldsieve.sources.tables import read_typed

#: The types a catalog may state. TINYINT is unsigned, so it needs a short; TIME stays text.
TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "INT64": T.LongType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP UTC": T.TimestampType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TINYINT": T.ShortType(),
    "TIME": T.StringType(),
}
#: The three tables of a catalog.
PARTS = ("index", "relations", "structure")
#: Columns whose names decide their type.
BY_NAME = {"timestamp_utc": "TIMESTAMP UTC", "timestamp_local": "STRING"}


def _rows(path: Path) -> list[dict[str, str | None]]:
    with path.open(encoding="utf-8-sig", newline="") as f:  # a byte-order mark may lead
        return [{k: v or None for k, v in row.items()} for row in csv.DictReader(f)]


@dataclass(frozen=True)
class Catalog:
    """index: files with table_id, directory and location; relations: table_id_in, table_id_out; structure: table_id, column_name, data_type."""

    index_files: tuple[str, ...]
    relation_files: tuple[str, ...] = ()
    structure_files: tuple[str, ...] = ()

    @cached_property
    def index(self) -> list[dict[str, str | None]]:
        return [r for f in self.index_files for r in _rows(Path(f))]

    @cached_property
    def relations(self) -> list[dict[str, str | None]]:
        return [r for f in self.relation_files for r in _rows(Path(f))]

    @cached_property
    def structure(self) -> list[dict[str, str | None]]:
        return [r for f in self.structure_files for r in _rows(Path(f))]

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """index, relations or structure as a DataFrame of text columns."""
        rows = getattr(self, name)
        columns = list(rows[0]) if rows else []
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c in columns]))

    def column_order(self, table_id: str) -> list[str]:
        out = [str(r["column_name"]) for r in self.structure if r["table_id"] == table_id]
        if not out:
            raise ValueError(f"the catalog has no structure for {table_id}")
        return out

    def schema(self, table_id: str) -> T.StructType:
        self.column_order(table_id)
        fields = []
        for r in self.structure:
            if r["table_id"] == table_id:
                kind = BY_NAME.get(str(r["column_name"]), str(r["data_type"]))
                if kind not in TYPES:
                    raise ValueError(f"unknown type {kind} of {table_id}.{r['column_name']}")
                fields.append(T.StructField(str(r["column_name"]), TYPES[kind]))
        return T.StructType(fields)

    def path(self, table_id: str, root: str | None = None, root_variable: str = "FIELD_DATA_ROOT", location: str = "github") -> str:
        """The folder of a table: the root (else the environment variable's) and the index's directory."""
        rows = [r for r in self.index if r.get("table_id") == table_id]
        if not rows:
            raise ValueError(f"the catalog has no table {table_id}")
        if rows[0].get("location") != location or not rows[0].get("directory"):
            raise ValueError(f"{table_id} is not stored where its path is known")
        root = root or os.environ.get(root_variable)
        if not root:
            raise ValueError(f"no root folder: set {root_variable} or give one")
        return f"{root.rstrip('/')}/{rows[0]['directory']}"

    def scan(self, spark: SparkSession, table_id: str, root: str | None = None) -> DataFrame:
        """All CSV files of a table, lazily, under its schema."""
        return read_typed(spark, self.path(table_id, root), self.schema(table_id))

    def outputs_of(self, table_id: str) -> list[str]:
        return sorted({str(r["table_id_out"]) for r in self.relations if r["table_id_in"] == table_id and r["table_id_out"]})

    def gaps(self) -> dict[str, list[str]]:
        """Tables of the structure that the index lacks, and tables that relations lead to without a structure."""
        typed, listed = {r["table_id"] for r in self.structure}, {r["table_id"] for r in self.index}
        return {"not_in_index": sorted(map(str, typed - listed)), "without_structure": sorted({str(r["table_id_out"]) for r in self.relations if r["table_id_out"] not in typed})}


@dataclass(frozen=True)
class CatalogTables:
    """A catalog as tables in Spark: index (table_id, ...), relations (table_id_in, table_id_out), structure (table_id, column_name, data_type)."""

    index: DataFrame
    relations: DataFrame
    structure: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, catalog: Catalog) -> CatalogTables:
        return cls(*(catalog.frame(spark, n) for n in PARTS))

    @classmethod
    def described(cls, tables: dict[str, DataFrame], relations: DataFrame) -> CatalogTables:
        """The catalog of tables that are there, its structure being their schemas."""
        kinds = {kind: name for name, kind in reversed(TYPES.items())}
        rows = [(t, f.name, kinds.get(f.dataType, f.dataType.simpleString().upper())) for t, df in tables.items() for f in df.schema]
        spark = relations.sparkSession
        return cls(spark.createDataFrame([(t,) for t in tables], "table_id string"), relations, spark.createDataFrame(rows, "table_id string, column_name string, data_type string"))

    def save(self, folder: str, mode: str = "errorifexists") -> None:
        """Keeps the three tables in a folder, from which load() has them without their files."""
        for n in PARTS:
            getattr(self, n).write.mode(mode).parquet(f"{folder.rstrip('/')}/{n}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CatalogTables:
        return cls(*(spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in PARTS))

    def register(self, prefix: str = "catalog_") -> None:
        """The three tables as views, for SQL."""
        for n in PARTS:
            getattr(self, n).createOrReplaceTempView(prefix + n)

    def outputs(self, most: int = 100) -> DataFrame:
        """(table_id_in, table_id_out, steps) of all tables that come of a table, directly or through others, by the fewest steps.

        Each round joins what the last one reached with the relations and drops what is known, so
        cycles end; a round's rows are a written table. Over `most` rounds raise an error.
        """
        edges = written(self.relations.where("table_id_in IS NOT NULL AND table_id_out IS NOT NULL").select("table_id_in", "table_id_out").distinct(), "relations")
        step = edges.select(F.col("table_id_in").alias("__via"), F.col("table_id_out").alias("__next"))
        found = last = edges.withColumn("steps", F.lit(1))
        for n in range(2, most + 2):
            reached = last.join(step, F.col("table_id_out") == F.col("__via")).select("table_id_in", F.col("__next").alias("table_id_out")).distinct()
            last = written(reached.join(found, ["table_id_in", "table_id_out"], "left_anti").withColumn("steps", F.lit(n)), "reached")
            if last.isEmpty():
                return found
            found = found.unionByName(last)
        raise RuntimeError(f"tables are derived through more than {most} others")

    def resolved(self) -> DataFrame:
        """outputs() with n_columns, how many columns the catalog has for the table that comes out; 0 where it lacks its structure."""
        columns = self.structure.groupBy(F.col("table_id").alias("table_id_out")).agg(F.count("*").alias("n_columns"))
        out = self.outputs().join(columns, "table_id_out", "left")
        return out.select("table_id_in", "table_id_out", "steps", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))

    def gaps(self) -> DataFrame:
        """(table_id, gap): tables of the structure that the index lacks, and tables that relations lead to without a structure."""
        typed, listed = self.structure.select("table_id").distinct(), self.index.select("table_id").distinct()
        led = self.relations.select(F.col("table_id_out").alias("table_id")).where("table_id IS NOT NULL").distinct()
        return typed.join(listed, "table_id", "left_anti").withColumn("gap", F.lit("not_in_index")).union(led.join(typed, "table_id", "left_anti").withColumn("gap", F.lit("without_structure")))
