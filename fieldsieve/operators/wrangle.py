"""Conditions and replacements made from selected cells, and named transforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from fieldsieve.functions.nulls import qcol
from fieldsieve.operators.events import event_id
from fieldsieve.operators.joins import fill_metadata

Cells = list[tuple[int, str]]
#: Named transforms, each a function of one table; text is never evaluated.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: Branches of one generated expression.
MOST_BRANCHES = 1000


def transform(name: str):
    """Registers a function under a name."""

    def keep(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        TRANSFORMS[name] = function
        return function

    return keep


def apply(df: DataFrame, *names: str) -> DataFrame:
    unknown = [n for n in names if n not in TRANSFORMS]
    if unknown:
        raise ValueError("no such transform: " + ", ".join(unknown))
    return reduce(lambda out, n: out.transform(TRANSFORMS[n]), names, df)


@transform("event_id")
def with_event_id(df: DataFrame) -> DataFrame:
    """Adds sample_event_id, made of site, date and depth."""
    return df.withColumn("sample_event_id", event_id(F.col("site_code"), F.col("date"), F.col("depth")))


@transform("fill_metadata")
def with_filled_metadata(df: DataFrame) -> DataFrame:
    """Missing metadata from other rows of the same event."""
    return fill_metadata(df, df)


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str("NA" if value is None else value).replace("'", "''") + "'"


def _values(rows: dict[int, Row], cells: Cells) -> dict[str, list]:
    """The distinct values selected in each column, in the order of selection."""
    out: dict[str, list] = {}
    for row, column in cells:
        value = rows[row][column]
        if value not in out.setdefault(column, []):
            out[column].append(value)
    return out


def _one(column: str, values: list) -> tuple[Column, str]:
    texts = [F.lit("NA" if v is None else v) for v in values]
    if len(values) == 1:
        return qcol(column) == texts[0], f"`{column}` = {_literal(values[0])}"
    return qcol(column).isin(*["NA" if v is None else v for v in values]), f"`{column}` IN ({', '.join(map(_literal, values))})"


def cells_filter(rows: dict[int, Row], cells: Cells) -> tuple[Column, str]:
    """A condition that holds for the selected cells: one test a column, all of them; a null counts as the text NA."""
    parts = [_one(c, v) for c, v in _values(rows, cells).items()]
    return reduce(lambda a, b: a & b, [p[0] for p in parts]), " AND ".join(p[1] for p in parts)


def cells_case_when(rows: dict[int, Row], cells: Cells, replacement: dict, every: DataFrame | None = None) -> tuple[Column, str]:
    """The first selected column with a branch for each of its selected values, under the tests of the other columns.

    every: a table; there is a branch for each value that the first column has in it.
    """
    values = _values(rows, cells)
    first, *others = values
    if every is not None:
        values[first] = [r[0] for r in combinations(every, first, [])]
    tests = [_one(c, values[c]) for c in others]
    out, texts = None, []
    for v in values[first]:
        condition, text = _one(first, [v])
        for t in tests:
            condition, text = condition & t[0], f"{text} AND {t[1]}"
        new = replacement.get(v, "")
        out = F.when(condition, F.lit(new)) if out is None else out.when(condition, F.lit(new))
        texts.append(f"WHEN {text} THEN {_literal(new)}")
    return out.otherwise(qcol(first)), f"CASE {' '.join(texts)} ELSE `{first}` END"


def combinations(df: DataFrame, x: str, ys: list[str], values: list | None = None) -> list[tuple]:
    """The distinct (x, ys...) of df, sorted, nulls first; values: only where x is one of them.

    Each becomes a branch of an expression, so more than MOST_BRANCHES raise an error rather than being cut off.
    """
    columns = [x, *ys]
    if values is not None:
        df = df.where(reduce(lambda a, b: a | b, [qcol(x).eqNullSafe(F.lit(v)) for v in values], F.lit(False)))
    found = df.select(*[qcol(c) for c in columns]).distinct().limit(MOST_BRANCHES + 1).collect()
    if len(found) > MOST_BRANCHES:
        raise ValueError(f"more than {MOST_BRANCHES} combinations of {', '.join(columns)}")
    return sorted(map(tuple, found), key=lambda r: [(v is not None, str(v)) for v in r])


def x_for_values(df: DataFrame, x: str, ys: list[str], replacement: dict) -> tuple[Column, str]:
    """Column x with a branch for each combination with ys that df has for the values that replacement (old: new) names."""
    found = combinations(df, x, ys, list(replacement))
    return x_for_all_y(df, x, ys, {key: replacement[key[0]] for key in found})


def x_for_all_y(df: DataFrame, x: str, ys: list[str], replacement: dict[tuple, object]) -> tuple[Column, str]:
    """Column x with a branch for each distinct (x, ys...) of df that replacement names; nulls are tested as nulls.

    Only the combinations that replacement names come to the driver.
    """
    test = lambda c, v: (qcol(c).isNull(), f"`{c}` IS NULL") if v is None else (qcol(c) == F.lit(v), f"`{c}` = {_literal(v)}")
    out, texts = None, []
    for key in sorted(replacement, key=str):
        parts = [test(c, v) for c, v in zip([x, *ys], key, strict=True)]
        condition, text = reduce(lambda a, b: a & b, [p[0] for p in parts]), " AND ".join(p[1] for p in parts)
        out = F.when(condition, F.lit(replacement[key])) if out is None else out.when(condition, F.lit(replacement[key]))
        texts.append(f"WHEN {text} THEN {_literal(replacement[key])}")
    if out is None:
        return qcol(x), f"`{x}`"
    return out.otherwise(qcol(x)), f"CASE {' '.join(texts)} ELSE `{x}` END"


def template(table: str, columns: list[str]) -> str:
    """The text of a processing script for one table: read, transform, order columns, write."""
    names = ",\n    ".join(repr(c) for c in columns)
    return f'''"""Processing of {table}."""
from fieldsieve.operators.ingest import select_strict
from fieldsieve.operators.wrangle import transform
from fieldsieve.sources.tables import write_csv

COLUMNS = [
    {names},
]


@transform({table!r})
def process(df):
    return select_strict(df, COLUMNS)


def save(df, path):
    write_csv(process(df), path, COLUMNS)
'''
