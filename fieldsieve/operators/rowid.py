"""Rows in a stated order, dealt to ranges of equal size: row numbers, and what else rests on neighbours.

A table is partitioned by ranges of all its order columns, sorted inside them and written, one file
for a range or several in a row. A row's place in its file is known to the reader, and the rows of
the files before it are counted in their footers, so numbering takes one shuffle and no window.
The place of a row in the input is the last order column: rows that tie are spread over ranges like
any others and keep their order, whatever the types, and however many rows hold one value or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldsieve.functions.nulls import qcol
from fieldsieve.sources.scratch import written

#: The name of the file that a row was written to, and its place there.
FILE, PLACE = "__range_file", "__range_place"
TIE = "__range_tie"


def in_ranges(df: DataFrame, order_by: list[str]) -> DataFrame:
    """df in ranges of order_by (ascending, nulls first), with FILE, a number that rises with the ranges, and PLACE. Runs jobs."""
    order = [*[qcol(c).asc_nulls_first() for c in order_by], F.col(TIE)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(ranged.drop(TIE), "ranges")
    part, file = (F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-.*?(?:-c(\d+))?\.", i).try_cast("long") for i in (1, 2))
    return table.select(*[qcol(c) for c in table.columns], (part * 1_000_000 + F.coalesce(file, F.lit(0))).alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def starts(ranges: DataFrame) -> DataFrame:
    """(FILE, __start): how many rows stand before a file's. A row for each file, so one task may add them up."""
    sizes = ranges.groupBy(FILE).agg(F.count("*").alias("__n"))
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(FILE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))


def with_rowid(df: DataFrame, order_by: list[str], name: str = "rowid") -> DataFrame:
    """Adds a 1-based number by the columns order_by (ascending, nulls first); rows that tie are numbered as they come.

    df is read once to find the ranges (a sample of the order columns) and once to write them.
    """
    ranges = in_ranges(df, order_by)
    out = ranges.join(F.broadcast(starts(ranges)), FILE)  # a row for each file
    return out.select(*[qcol(c) for c in df.columns], (F.col("__start") + F.col(PLACE) + 1).alias(name))


def run_lengths(df: DataFrame, value: Column, order: str, within: list[str]) -> DataFrame:
    """(within, value, run_start, run_end, run_length) of equal neighbours in each group, nulls being equal.

    Runs are found inside ranges of all rows, so a group may fill many of them; the first and last
    run of each range are then joined with their neighbours', and only these come together in one task.
    """
    keys = [f"__k{i}" for i in range(len(within))]
    rows = df.select(*[qcol(c).alias(k) for c, k in zip(within, keys, strict=True)], value.alias("__v"), qcol(order).alias("__o"))
    ranges = in_ranges(rows, [*keys, "__o"])
    inside = Window.partitionBy(FILE).orderBy(PLACE)
    same = F.struct(*keys, "__v")
    new = F.when(F.lag(same).over(inside).eqNullSafe(same), 0).otherwise(1)
    run = F.sum(new).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    parts = ranges.withColumn("__run", run).groupBy(FILE, "__run", *keys, "__v").agg(F.min("__o").alias("run_start"), F.max("__o").alias("run_end"), F.count("*").alias("run_length"))
    parts = written(parts, "runs")
    last = parts.groupBy(FILE).agg(F.max("__run").alias("__last"))
    parts = parts.join(F.broadcast(last), FILE)
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
    along = Window.orderBy(FILE, "__run")
    begins = F.when((F.lag(same).over(along)).eqNullSafe(same) & (F.lag(FILE).over(along) != F.col(FILE)), 0).otherwise(1)
    edges = parts.where(edge).withColumn("__new", begins).withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))  # two rows a file
    joined = edges.groupBy("__island", *keys, "__v").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("run_length").alias("run_length"))
    columns = [*[F.col(k).alias(c) for c, k in zip(within, keys, strict=True)], F.col("__v").alias("value"), "run_start", "run_end", "run_length"]
    return parts.where(~edge).select(*columns).union(joined.select(*columns))


def ordered_join(df: DataFrame, keys: list[str], value: str, order: list[str], separator: str = ", ", most: int = 1 << 29) -> DataFrame:
    """(keys, value): the values of each group as one text in a stated order; nulls are left out, and a group of nulls has an empty text.

    A large group is sorted and joined in several ranges, whose texts are then joined in turn.
    The text of a group is one value of one row: over `most` characters it raises an error.
    """
    ranges = in_ranges(df.select(*[qcol(k) for k in keys], *[qcol(c).alias(f"__o{i}") for i, c in enumerate(order)], qcol(value).cast("string").alias("__v")), [*keys, *[f"__o{i}" for i in range(len(order))]])
    pieces = ranges.groupBy(*[qcol(k) for k in keys], FILE).agg(F.sort_array(F.collect_list(F.struct(PLACE, "__v"))).alias("l"))
    pieces = pieces.withColumn("t", F.when(F.exists("l", lambda x: x["__v"].isNotNull()), F.array_join(F.transform("l", lambda x: x["__v"]), separator))).drop("l")
    whole = pieces.groupBy(*[qcol(k) for k in keys]).agg(F.sort_array(F.collect_list(F.struct(FILE, "t"))).alias("l"), F.sum(F.length("t").cast("long")).alias("n"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), separator)
    return whole.select(*[qcol(k) for k in keys], F.when(F.coalesce("n", F.lit(0)) <= most, text).otherwise(F.raise_error(F.lit(f"a group's text has over {most} characters"))).alias(value))
