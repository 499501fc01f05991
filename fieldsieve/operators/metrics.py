"""Abundance and richness, column profiles, schema conformance, and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldsieve.functions.nulls import count_distinct_na, qcol, row_sum, sum_na
from fieldsieve.operators.rowid import run_lengths


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from first to last, as they stand."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.columns[min(a, b) : max(a, b) + 1]


def longer(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long; null values stay."""
    return df.unpivot([qcol(c) for c in ids], [qcol(c) for c in values], name, value)


def abundance_richness(df: DataFrame, keys: list[str], counts: list[str], taxon: str) -> DataFrame:
    """For the keys: the sum of all count columns, and how many taxa there are, a missing one included. Each row is read once."""
    return df.groupBy(*[qcol(k) for k in keys]).agg(sum_na(row_sum(df, counts)).alias("abundance"), count_distinct_na(qcol(taxon)).alias("richness"))


def column_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, type, n_values, n_null, n_unique) of each column; null is one of the unique values.

    Values travel once, as (column, value) pairs that are counted before and after the shuffle, however
    many columns there are. exact False: unique values by a sketch, and one row is all that travels.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    if not exact:
        stats = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.count(qcol(c)).alias("n_values"), F.count_if(qcol(c).isNull()).alias("n_null"), (F.approx_count_distinct(qcol(c)) + F.coalesce(F.max(qcol(c).isNull().cast("long")), F.lit(0))).alias("n_unique")) for c in columns]
        return df.agg(F.array(*stats).alias("a")).select(F.inline("a"))
    value = lambda c: F.when(qcol(c) == 0, F.lit("0")).otherwise(qcol(c).cast("string")) if kinds[c] in ("double", "float") else qcol(c).cast("string")  # noqa: E731  -0.0 is 0.0
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(columns)])).alias("p")).select("p.i", "p.v")
    each = pairs.groupBy("i", "v").agg(F.count("*").alias("n"))
    found = each.groupBy("i").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("n_values"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("n_null"), F.count("*").alias("n_unique"))
    names = df.sparkSession.createDataFrame([(i, c, kinds[c]) for i, c in enumerate(columns)], "i int, column_name string, type string")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_values", "n_null", "n_unique")]
    return names.join(found, "i", "left").select("column_name", "type", *counts)


def column_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, least, greatest, n_null) of number columns."""
    stats = [F.struct(F.lit(c).alias("column_name"), F.min(qcol(c)).cast("double").alias("least"), F.max(qcol(c)).cast("double").alias("greatest"), F.count_if(qcol(c).isNull()).alias("n_null")) for c in columns]
    return df.agg(F.array(*stats).alias("a")).select(F.inline("a"))


def conformance(df: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """(column_name, expected_type, found_type, status, n_failing) for the columns that are expected or there, in one pass.

    n_failing: values of a column of another type that are no value of the expected one; null where a column is missing or not expected.
    """
    found = dict(df.dtypes)
    names = [n for n, _ in expected]

    def fails(name: str, kind: str) -> Column:
        if kind == found[name]:
            return F.lit(0).cast("long")
        cast = qcol(name).try_cast(kind)
        lost = (cast.cast("double") != qcol(name)) if found[name] in ("double", "float") and kind in ("int", "bigint", "smallint") else F.lit(False)
        return F.count_if(qcol(name).isNotNull() & (cast.isNull() | lost))

    row = lambda n, e, f, s, k: F.struct(F.lit(n).alias("column_name"), F.lit(e).cast("string").alias("expected_type"), F.lit(f).cast("string").alias("found_type"), F.lit(s).alias("status"), k.cast("long").alias("n_failing"))
    rows = [row(n, t, found.get(n), "missing" if n not in found else "ok" if found[n] == t else "type differs", fails(n, t) if n in found else F.lit(None)) for n, t in expected]
    rows += [row(n, None, t, "unexpected", F.lit(None)) for n, t in df.dtypes if n not in names]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first_at): distinct values and where each comes first."""
    return df.groupBy(qcol(value).alias("value")).agg(F.min(qcol(order)).alias("first_at"))


def first_values(df: DataFrame, value: str, order: str, n: int = 10) -> DataFrame:
    """The first n distinct values in order of appearance, with how many there are in all."""
    seen = first_seen(df, value, order)
    return seen.crossJoin(seen.agg(F.count("*").alias("n_unique"))).orderBy("first_at").limit(n)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count("*").alias("n")).orderBy(*[qcol(k) for k in keys])


def wider(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide, the columns as named; the least value where there are several."""
    return df.groupBy(*[qcol(c) for c in ids]).pivot(name, names).agg(F.min(qcol(value)))


def runs(df: DataFrame, condition: Column, order: str, within: list[str]) -> DataFrame:
    """Run-length encoding: (within, value, run_start, run_end, run_length) of equal neighbours in a stated order. Runs jobs."""
    return run_lengths(df, condition, order, within)
