"""The driver's tables seen as survey tables: one set of expressions for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldsieve.operators.rowid import with_rowid

LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
SURVEY = {
    "site_code": "concat('S', CAST(l_suppkey % 7 AS STRING))",
    "date": "CAST(l_shipdate AS DATE)",
    "depth": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) + CASE WHEN l_suppkey % 2 = 0 THEN 0.5E0 ELSE 0E0 END END",
    "method": "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_linenumber % 3 END",
    "block": "CAST(l_suppkey % 3 AS INT)",
    "diver": "CASE WHEN l_orderkey % 10 = 0 THEN 'BLANK' WHEN l_orderkey % 10 = 1 THEN NULL WHEN l_orderkey % 10 = 2 THEN '' ELSE concat('D', CAST(l_orderkey % 4 AS STRING)) END",
    "vis": "CASE WHEN l_partkey % 6 = 0 THEN 'BLANK' ELSE CAST(l_partkey % 9 AS STRING) END",
    "phylum": "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'Chordata' WHEN l_returnflag = 'R' THEN 'Mollusca' ELSE 'Arthropoda' END",
    "taxonomic_id": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 200 AS INT) - 50 END",
    "total": "CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_quantity <= 2 THEN 0E0 ELSE l_quantity * 3 END",
    "inverts": "CASE WHEN l_linenumber > 4 THEN l_quantity ELSE 0E0 END",
    "2.5": "CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) ELSE NULL END",
    "5": "CAST(l_suppkey % 2 AS INT)",
    "7.5": "CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 0 END",
    "species": "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE concat('sp', CAST(l_partkey % 40 AS STRING)) END",
    "input_filename": "concat('f', CAST(l_orderkey % 3 AS STRING), '.xlsx')",
}
SIZES = ["2.5", "5", "7.5"]
META = ["diver", "site_code", "depth", "vis"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str, rowid: bool = True) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity", "l_returnflag")
    lines = with_rowid(lines, LINE_ORDER) if rowid else lines
    return lines.select(*["rowid"] * rowid, *[F.expr(e).alias(n) for n, e in SURVEY.items()])


def survey_sql(body: str) -> str:
    """SQL with `survey` before it."""
    columns = ", ".join(f'{e.replace("STRING", "VARCHAR")} AS "{n}"' for n, e in SURVEY.items())
    order = ", ".join(LINE_ORDER)
    return f"WITH survey AS (SELECT row_number() OVER (ORDER BY {order}) AS rowid, {columns} FROM lineitem) {body}"
