"""From a sheet as it was typed to a table: one declarative specification for each kind of table."""

from __future__ import annotations

import os
import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from fieldsieve.functions.nulls import qcol, require_columns, to_number
from fieldsieve.functions.text import base_name, canonical_names
from fieldsieve.operators.joins import join_taxonomy

#: Fixed value: what the method column holds in a header row that was typed again among the data.
HEADER_MARK = "0, 1, 2"


#: The column that says which file a row is from.
LINEAGE = "input_filename"


def drop_header_rows(df: DataFrame, column: str = "Method", mark: str = HEADER_MARK) -> DataFrame:
    """Without repeated header rows, and without rows whose method is null."""
    return df.where(qcol(column).cast("string") != mark)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def trim_trailing_zeros(df: DataFrame, total: str = "Total", rowid: str = "rowid", per: str | None = None) -> DataFrame:
    """Without the last run of rows whose total is 0; zeros before stay. All rows stay if all are 0. A null total is not 0.

    per: a column that tells files apart, each of which has an end of its own.
    """
    return _up_to(df, _last_rows(df, total, rowid, per), rowid, per)


def _last_rows(df: DataFrame, total: str, rowid: str, per: str | None) -> DataFrame:
    """The last row whose total is not 0, of the table or of each file."""
    last = F.max(F.when(qcol(total).isNull() | (to_number(qcol(total).cast("string")) != 0), qcol(rowid))).alias("__last")
    return df.groupBy(qcol(per).alias("__file")).agg(last) if per else df.agg(last)


def _up_to(df: DataFrame, last: DataFrame, rowid: str, per: str | None) -> DataFrame:
    """The rows up to the last; all rows where there is none."""
    inside = F.col("__last").isNull() | (qcol(rowid) <= F.col("__last"))
    if per:
        return df.join(last, qcol(per).eqNullSafe(F.col("__file")), "left").where(inside).drop("__last", "__file")
    return df.join(F.broadcast(last), inside).drop("__last")  # one row


def rename_lenient(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames old to new where old is a column."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def rename_strict(df: DataFrame, names: dict[str, str]) -> DataFrame:
    require_columns(df, list(names))
    return df.withColumnsRenamed(names)


def select_lenient(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[qcol(n) for n in names if n in df.columns])


def select_strict(df: DataFrame, names: list[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*[qcol(n) for n in names])


def to_front(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[qcol(n) for n in [*names, *[c for c in df.columns if c not in names]]])


def move_after(df: DataFrame, name: str, other: str) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    at = rest.index(other) + 1
    return df.select(*[qcol(c) for c in [*rest[:at], name, *rest[at:]]])


@dataclass(frozen=True)
class Spec:
    """How a sheet becomes a table."""

    required: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    header_column: str | None = None
    trim_column: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    strict_rename: dict[str, str] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()
    taxonomy: str | None = None


#: Column names as typed, and as they are called afterwards.
SEAGRASS = {
    "Transect ID": "transect",
    "Location Name": "site_name",
    "Start Latitude": "transect_begin_decimal_latitude",
    "Start Longitude": "transect_begin_decimal_longitude",
    "End Latitude": "transect_end_decimal_latitude",
    "End Longitude": "transect_end_decimal_longitude",
    "Min Depth m": "depth_min_m",
    "Max Depth m": "depth_max_m",
    "Transect Notes": "sample_metadata_notes",
    "Shoots Count": "shoot_count",
    "Flowers Count": "flowers_p_a",
    "Grazing Scars Y N": "grazing_scars_p_a",
    "Tin Mass g (Epibionts)": "tin_mass_g_epibionts",
    "Tin Mass g (Blades)": "tin_mass_g_blades",
}
OYSTER_DEPLOYMENT = {
    "Water Present Y N": "water_present",
    "Logger Deployed Y N": "logger_deployed",
    "Spat Stick PVC or biobox": "spat_stick",
    "Sampling Personnel": "personnel",
    "Site Notes (including recent perturbations and weather conditions)": "notes",
}
SPECS: dict[str, Spec] = {
    "oyster-deployment": Spec(rename=OYSTER_DEPLOYMENT),
    "seagrass": Spec(drop=("ID",), rename=SEAGRASS),
    "reef-survey": Spec(required=("Total", "Method", "Site No.", "P-Qs", "Block", "Species"), header_column="Method", trim_column="Total", strict_rename={"Site No.": "site_code", "P-Qs": "photoquadrats"}, numbers=("Method", "Block"), taxonomy="Species"),
    "reef-survey-plain": Spec(required=("Total", "Method", "Site No.", "P-Qs"), header_column="Method", trim_column="Total", strict_rename={"Site No.": "site_code", "P-Qs": "photoquadrats"}),
    "plain": Spec(),
}


#: The tables that can be loaded, and the family of each.
FAMILIES = {
    "seagrass-biomass-monitoring-v1": "seagrass",
    "seagrass-cover-monitoring-v1": "seagrass",
    "seagrass-macroinvertebrates-monitoring-v1": "seagrass",
    "shoot-count-monitoring-v1": "seagrass",
    "seagrass-metadata-monitoring-v1": "seagrass",
    "seagrass-macrophyte-monitoring-v1": "seagrass",
    "seagrass-epifauna-monitoring-v1": "seagrass",
    "seagrass-macroalgae-monitoring-v1": "seagrass",
    "seagrass-blades-monitoring-v1": "seagrass",
    "sheath-and-epibiont-monitoring-v1": "seagrass",
    "oyster-2025-reef-metadata-deployment": "oyster-deployment",
    "oyster-2025-rugosity": "plain",
}
#: Of the reef survey's id only the beginning counts.
REEF_TABLE = "reef-life-survey-data-"


def family_of(table: str) -> str:
    if table.startswith(REEF_TABLE):
        return "reef-survey"
    if table not in FAMILIES:
        raise ValueError(f"no such table: {table}; known are {REEF_TABLE}..., {', '.join(FAMILIES)}")
    return FAMILIES[table]


class Steps:
    """How many rows each step of an ingest let through, observed in the job that reads the result: no scan of its own.

    removed() is there once an action on the ingested table has ended; before that it waits. The action
    must read each row once, as a write does: a sort by ranges samples its rows first and counts them twice.
    """

    def __init__(self):
        self.names: list[str] = []
        self.counts: list[Observation] = []

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        self.counts.append(Observation(f"{name}-{uuid.uuid4().hex}"))
        return df.observe(self.counts[-1], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int]]:
        """(step, rows after it)."""
        return [(n, o.get["rows"]) for n, o in zip(self.names, self.counts, strict=True)]

    def removed(self) -> list[tuple[str, int]]:
        """(step, rows that it removed), in order."""
        rows = self.rows()
        return [(name, before - after) for (_, before), (name, after) in zip(rows, rows[1:], strict=False)]


def load(df: DataFrame, table: str, filename: str | Column, ids: DataFrame | None = None, classes: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """A typed sheet with a row number as the table of this id.

    filename: the file that all rows are from, or the column input_filename, which names it for each row.
    steps: told how many rows each step removes, by the job that reads the result. Without it a job
    is run to warn if nothing is left.
    """
    out = ingest(df, SPECS[family_of(table)], filename, ids=ids, classes=classes, steps=steps)
    if steps is None and out.isEmpty():
        warnings.warn(f"{os.path.basename(filename) if isinstance(filename, str) else 'the sheet'} has no rows for {table}", stacklevel=2)
    return out


def load_counted(df: DataFrame, table: str, filename: str | Column, path: str, ids: DataFrame | None = None, classes: DataFrame | None = None) -> list[tuple[str, int]]:
    """Loads a sheet and writes the table as Parquet, in one job that also counts what each step removed; returns (step, rows removed)."""
    steps = Steps()
    out = load(df, table, filename, ids, classes, steps)
    out.write.parquet(path)
    if steps.rows() and steps.rows()[-1][1] == 0:
        warnings.warn(f"no rows are left for {table}", stacklevel=2)
    return steps.removed()


def ingest(df: DataFrame, spec: Spec, filename: str | Column, rowid: str = "rowid", ids: DataFrame | None = None, classes: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """A typed sheet with a row number as a table with canonical names and the column input_filename."""
    require_columns(df, [*spec.required, rowid])
    if spec.taxonomy and (ids is None or classes is None):
        raise ValueError("this table needs the taxonomy: ids and classes")
    watch = steps.watch if steps else lambda df, name: df
    trimmed = None
    if spec.trim_column:  # the end of the data is found in rows that nothing watches, so that no row counts twice
        ends = drop_header_rows(df, spec.header_column) if spec.header_column else df
        trimmed = _last_rows(ends, spec.trim_column, rowid, None if isinstance(filename, str) else LINEAGE)
    df = watch(df, "sheet")
    if any(c in df.columns for c in spec.drop):
        values = [qcol(c) for c in df.columns if c not in (*spec.drop, rowid, LINEAGE)]
        df = watch(df.drop(*spec.drop).where(~_all_null(values)), "empty_rows")
    if spec.header_column:
        df = watch(drop_header_rows(df, spec.header_column), "header_rows")
    if trimmed is not None:
        df = watch(_up_to(df, trimmed, rowid, None if isinstance(filename, str) else LINEAGE), "trailing_zeros")
    df = rename_strict(rename_lenient(df, spec.rename), spec.strict_rename)
    df = df.withColumns({c: to_number(qcol(c).cast("string")) for c in spec.numbers})
    if spec.taxonomy:
        df = join_taxonomy(df, ids, classes, spec.taxonomy, ["phylum"])
        df = move_after(df, "taxonomic_id", spec.taxonomy)
    return canonical_names(df.withColumn(LINEAGE, F.lit(os.path.basename(filename)) if isinstance(filename, str) else base_name(filename)))


def _all_null(values: list[Column]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNull()
    return out


def removed_rows(before: DataFrame, after: DataFrame) -> int:
    """How many rows a step removed; runs a job on each."""
    return before.count() - after.count()


def warn_if_all_zero(df: DataFrame, total: str = "Total") -> bool:
    """Warns, and says so, if no total differs from 0. Runs a job."""
    odd = df.where(qcol(total).isNull() | (to_number(qcol(total).cast("string")) != 0)).isEmpty()
    if odd:
        warnings.warn("every total is 0; no rows were removed", stacklevel=2)
    return odd
