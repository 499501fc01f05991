"""CSV tables: typed by a schema, or inferred; single files, lists and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldsieve.functions.nulls import qcol
from fieldsieve.operators.ingest import select_strict


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV files under a stated schema, by position, the header passed over. Empty and NA are null; what doesn't fit its type is null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    clean = lambda f: F.when(~qcol(f.name).isin("", "NA"), qcol(f.name))
    return raw.select(*[(clean(f) if isinstance(f.dataType, T.StringType) else clean(f).try_cast(f.dataType)).alias(f.name) for f in schema])


def read_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with types found by reading them once."""
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV files with the columns in a stated order."""
    select_strict(df, order).write.option("header", True).csv(path)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
