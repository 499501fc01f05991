"""Row-level quality rules: a registry, one scan for all of them, and flags by priority."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldsieve.functions.nulls import is_missing, is_text, measure, qcol, require_columns, row_sum, to_number

#: The metadata that each observation needs, and the size classes of fish counts.
METADATA = ["diver", "site_code", "site_name", "latitude", "longitude", "date", "depth", "vis", "direction", "time", "photoquadrats"]
SIZES = ["2.5", "5", "7.5", "10", "12.5", "15", "20", "25", "30", "35", "40", "50", "62.5", "75", "87.5", "100", "112.5", "137.5", "150", "162.5", "175", "187.5", "200", "250", "300", "350", "400"]
VERTEBRATE = "Chordata"


@dataclass(frozen=True)
class Rule:
    """A predicate over rows; its id is its priority, the least first."""

    id: int
    name: str
    description: str
    columns: tuple[str, ...]
    predicate: Callable[[DataFrame], Column]

    def on(self, df: DataFrame) -> Column:
        require_columns(df, list(self.columns))
        return self.predicate(df)


def missing_metadata(columns: list[str] = METADATA) -> Rule:
    return Rule(1, "missing_metadata", "a metadata column is null or BLANK", tuple(columns), lambda df: reduce(lambda a, b: a | b, [is_missing(c) for c in columns]))


def missing_taxonomic_id(column: str = "taxonomic_id", strict: bool = False) -> Rule:
    """strict: if the column holds text, every row."""

    def predicate(df: DataFrame) -> Column:
        if not is_text(df, column):
            return qcol(column).isNull()
        return F.lit(True) if strict else to_number(qcol(column), "bigint").isNull()

    return Rule(2, "missing_taxonomic_id", "the taxonomic id is missing", (column,), predicate)


def vertebrate_with_invertebrate_count(inverts: str = "inverts", phylum: str = "phylum") -> Rule:
    return Rule(3, "vertebrate_with_invertebrate_count", "a vertebrate has an invertebrate count", (inverts, phylum), lambda df: (measure(df, inverts) > 0) & (qcol(phylum) == VERTEBRATE))


def invertebrate_with_sizes(sizes: list[str] = SIZES, phylum: str = "phylum", include_125: bool = False) -> Rule:
    sizes = [*sizes, *["125"] * include_125]
    return Rule(4, "invertebrate_with_sizes", "an invertebrate is counted in size classes", (phylum, *sizes), lambda df: (qcol(phylum) != VERTEBRATE) & (row_sum(df, sizes) > 0))


def total_zero(total: str = "total") -> Rule:
    return Rule(5, "total_zero", "the total count is 0", (total,), lambda df: measure(df, total) == 0)


def fish_over(limit: float = 100, total: str = "total", phylum: str = "phylum") -> Rule:
    return Rule(6, "fish_over_100", "a fish count is over 100", (total, phylum), lambda df: (qcol(phylum) == VERTEBRATE) & (measure(df, total) > limit))


def inverts_over(limit: float = 20, inverts: str = "inverts", phylum: str = "phylum") -> Rule:
    return Rule(7, "inverts_over_20", "an invertebrate count is over 20", (inverts, phylum), lambda df: (qcol(phylum) != VERTEBRATE) & (measure(df, inverts) > limit))


#: The rules of each table; a table without an entry has none.
REGISTRY: dict[str, list[Rule]] = {
    "reef-survey": [missing_metadata(), missing_taxonomic_id(), vertebrate_with_invertebrate_count(), invertebrate_with_sizes(), total_zero(), fish_over(), inverts_over()],
}


def rows_flagged(df: DataFrame, rule: Rule, rowid: str = "rowid") -> DataFrame:
    """(rowid) of the rows for which the rule is true; empty if there are none."""
    return df.where(rule.on(df)).select(qcol(rowid).cast("long").alias("rowid"))


def flags(df: DataFrame, rules: list[Rule], rowid: str = "rowid") -> DataFrame:
    """(test_name, test_id, row_num) of every rule and row, from one scan."""
    hits = [F.when(r.on(df), F.struct(F.lit(r.name).alias("test_name"), F.lit(r.id).alias("test_id"))) for r in rules]
    kind = "array<struct<test_name:string,test_id:int>>"
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast(kind)
    return df.select(qcol(rowid).cast("long").alias("row_num"), F.explode(found).alias("f")).select("f.test_name", "f.test_id", "row_num")


def run_all(df: DataFrame, table: str, rowid: str = "rowid") -> DataFrame:
    return flags(df, REGISTRY.get(table, []), rowid)


def first_flag(found: DataFrame) -> DataFrame:
    """(row_num, test_id): one flag a row, the least id."""
    return found.groupBy("row_num").agg(F.min("test_id").alias("test_id"))


def least_flag(df: DataFrame, rules: list[Rule]) -> Column:
    """The least id of the rules that hold for a row, null if none does: an expression, so nothing is shuffled or joined."""
    hits = [F.when(r.on(df), F.lit(r.id)) for r in sorted(rules, key=lambda r: r.id)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("int")


def flag_priority(df: DataFrame, rules: list[Rule], rowid: str = "rowid") -> DataFrame:
    """(row_num, test_id): first_flag(flags(df, rules)) straight from the rows."""
    return df.select(qcol(rowid).cast("long").alias("row_num"), least_flag(df, rules).alias("test_id")).where("test_id is not null")


def flagged(df: DataFrame, rules: list[Rule], flagged_only: bool = False) -> DataFrame:
    """df with the test_id of its row; null where there is none. What with_flags() gives for flags of df itself."""
    out = df.withColumn("test_id", least_flag(df, rules))
    return out.where("test_id is not null") if flagged_only else out


def one_rule(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.col("test_name") == name)


def with_flags(df: DataFrame, one_a_row: DataFrame, rowid: str = "rowid", flagged_only: bool = False) -> DataFrame:
    """df with the test_id of its row from a table of flags made elsewhere; null where there is none."""
    out = df.join(one_a_row.withColumnRenamed("row_num", rowid), rowid, "left")
    return out.where(F.col("test_id").isNotNull()) if flagged_only else out
