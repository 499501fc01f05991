"""Expressions for the missing-value rules of survey tables, where they differ from SQL's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

BLANK = "BLANK"


def qcol(name: str) -> Column:
    """A column by its name, which may hold dots (size classes such as `2.5`)."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Raise ValueError that lists the columns df lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing required column(s): " + ", ".join(missing))


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text; NaN prints as NaN and is not null."""
    return df.select(*[qcol(c).cast("string").alias(c) for c in df.columns])


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_missing(name: str) -> Column:
    """Null, or the literal BLANK; an empty string is not missing."""
    text = qcol(name).cast("string")
    return text.isNull() | (text == BLANK)


def nullif_blank(df: DataFrame, names: list[str]) -> DataFrame:
    """BLANK becomes null in those of the columns that hold text."""
    return df.withColumns({n: F.when(qcol(n) != BLANK, qcol(n)) for n in names if is_text(df, n)})


def any3(condition: Column) -> Column:
    """Aggregate: true if any is true, else null if any is null, else false."""
    return F.when(F.max(condition), F.lit(True)).when(F.count_if(condition.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def count_distinct_na(value: Column) -> Column:
    """Aggregate: distinct values, with null as one."""
    return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("long")), F.lit(0))


def sum_na(value: Column) -> Column:
    """Aggregate: a sum that skips nulls and is 0 when all are null."""
    return F.coalesce(F.sum(value), F.lit(0))


def fmt_num(value: Column) -> Column:
    """A number as text: no decimals if it is whole, else up to 15 significant digits."""
    whole = value.cast("bigint").cast("string")
    other = F.regexp_replace(F.format_string("%.15f", value), r"\.?0+$", "")
    digits = F.regexp_replace(F.format_string("%.15g", value), r"(\.\d*?)0+$", "$1")
    plain = F.when(F.abs(value) >= 1e-4, F.regexp_replace(digits, r"\.$", "")).otherwise(other)
    return F.when(value.isNull(), None).when((value == F.floor(value)) & (F.abs(value) < 1e15), whole).otherwise(plain)


def paste_na(separator: str, *parts: Column) -> Column:
    """Parts as text with a separator; a null prints as NA."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def to_number(value: Column, kind: str = "double") -> Column:
    """A cast that gives null where the text is no number."""
    return value.try_cast(kind)


def measure(df: DataFrame, name: str) -> Column:
    """A column to compare with numbers: text is cast, NaN counts as null."""
    column = to_number(qcol(name)) if is_text(df, name) else qcol(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType, T.StringType)):
        return F.when(~F.isnan(column.cast("double")), column)
    return column


def row_sum(df: DataFrame, names: list[str]) -> Column:
    """The sum of several columns, null as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(measure(df, n).cast("double"), F.lit(0.0)) for n in names])
