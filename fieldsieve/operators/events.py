"""Sampling events: summaries, rosters, and how their metadata varies between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldsieve.functions.nulls import any3, fmt_num, paste_na, qcol, require_columns
from fieldsieve.functions.text import date_of
from fieldsieve.operators.joins import natural_left_join
from fieldsieve.operators.rowid import ordered_join


def event_id(site: Column, date: Column, depth: Column) -> Column:
    """site_RLS_date_depth, with NA for what is missing."""
    return paste_na("_", site, F.lit("RLS"), date, fmt_num(depth.cast("double")))


def event_summary(df: DataFrame, site: str = "site_code", date: str = "date", depth: str = "depth", method: str = "method", block: str = "block") -> DataFrame:
    """One row an event, sorted by its id: whether each of methods 1 and 2 has blocks 1 and 2; null where that is unknown."""
    require_columns(df, [site, date, depth, method, block])
    has = lambda m, b: any3((qcol(method) == m) & (qcol(block) == b)).alias(f"method_{m}_block_{b}")
    out = df.groupBy(qcol(site).alias("site_code"), qcol(date).alias("date"), qcol(depth).alias("depth")).agg(*[has(m, b) for m in (1, 2) for b in (1, 2)])
    key = event_id(F.col("site_code"), F.col("date"), F.col("depth")).alias("sample_event_id")
    return out.select(key, *[qcol(c) for c in out.columns]).orderBy("sample_event_id")


def roster_check(df: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct events of df with what the roster says of them."""
    return df.select(*[qcol(k) for k in keys]).distinct().join(roster, keys, "left")


def metadata_variants(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: the distinct values of each column, NA for null, in ascending order with commas."""
    texts = {c: F.coalesce(qcol(c).cast("string"), F.lit("NA")) for c in columns}
    return df.groupBy(key).agg(*[F.array_join(F.sort_array(F.collect_set(t)), ", ").alias(c) for c, t in texts.items()])


def events_across_files(stored: DataFrame, current: DataFrame, file: str, key: str, columns: list[str], summary: DataFrame) -> DataFrame:
    """The event summary with metadata variants over the stored files, the current file's rows replaced by `current`."""
    others = stored.where(qcol("input_filename") != file)
    every = others.unionByName(current, allowMissingColumns=True)
    return natural_left_join(summary, metadata_variants(every, key, columns))


def joined_text(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row for the keys with the values of a column in a stated order, with commas. Runs jobs."""
    return ordered_join(df, keys, value, order)


def two_transect_roster(roster: DataFrame, site: str = "Site Code", fields: tuple[str, ...] = ("Initials", "Depth", "Year", "Month", "Day"), transects: tuple[str, ...] = ("T1", "T2")) -> DataFrame:
    """A roster with the columns of two transects side by side as a row for each transect, with date and event id.

    Sites without initials for either are left out; a site with one keeps an empty row for the other.
    """
    some = roster.where(" OR ".join(f"`{t} {fields[0]}` IS NOT NULL" for t in transects))
    parts = [some.select(qcol(site).alias("site_code"), F.lit(t).alias("transect"), *[qcol(f"{t} {f}").alias(f.lower()) for f in fields]) for t in transects]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("date", date_of(F.col("year"), F.col("month"), F.col("day"))).drop("year", "month", "day")
    return out.withColumn("sample_event_id", event_id(F.col("site_code"), F.col("date"), F.col("depth")))


def diver_roster(rosters: list[DataFrame], event: str, diver: str, order: list[str], keep: list[str]) -> DataFrame:
    """Several rosters, columns by name, as one row an event with its divers in a stated order."""
    every = rosters[0]
    for r in rosters[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    every = every.select(*{event: 0, diver: 0, **dict.fromkeys(order, 0), **dict.fromkeys(keep, 0)}).distinct()
    return joined_text(every, [event, *keep], diver, order)
