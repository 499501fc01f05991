"""Taxonomic enrichment, key sets, patches of missing values, and the joins they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldsieve.functions.nulls import nullif_blank, qcol, require_columns
from fieldsieve.functions.text import strip_rank_suffix
from fieldsieve.sources.store import KeyedStore

#: A key with more than this share of all rows is hot, so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 64
#: So many lookup rows of hot keys are sent to every task.
MOST_SENT = 100_000


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """A left join in which null matches null and columns of one name become name.x and name.y."""
    right_key = right_key or key
    both = [c for c in right.columns if c != right_key and c in left.columns]
    left = left.withColumnsRenamed({c: f"{c}.x" for c in both if c != key})
    right = right.withColumnsRenamed({c: f"{c}.y" for c in both}).withColumnRenamed(right_key, "__key")
    return left.join(right, qcol(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The values of a column, null among them, that more than `share` of all rows have: fewer than 1 / share, however large df is."""
    least = df.count() * share
    return [r["k"] for r in df.groupBy(qcol(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("k").collect()]


def _among(column: Column, values: list) -> Column:
    """Whether a column has one of the values, null being a value; never null."""
    out = F.coalesce(column.isin([v for v in values if v is not None]), F.lit(False))
    return out | column.isNull() if None in values else out & column.isNotNull()


def left_join_split(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, share: float = HOT_SHARE) -> DataFrame:
    """left_join_suffixed() for a lookup that is too large to be sent to every task, where null or other keys are hot.

    Rows of hot keys meet the lookup's rows of these keys without a shuffle: they are sent to every
    task, if there are at most MOST_SENT of them. Beyond that a hot key's rows are dealt to 1 / share
    parts by a hash of the row, and the lookup's rows of hot keys go to all parts. All other rows
    are shuffled by keys none of which is hot. Rows come in no stated order.
    """
    right_key = right_key or key
    hot = hot_keys(left, key, share)
    if not hot:
        return left_join_suffixed(left, right, key, right_key)
    near, known = _among(qcol(key), hot), right.where(_among(qcol(right_key), hot))
    others = left_join_suffixed(left.where(~near), right.where(~_among(qcol(right_key), hot)), key, right_key)
    if known.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return left_join_suffixed(left.where(near), F.broadcast(known), key, right_key).unionByName(others)
    parts = round(1 / share)
    dealt = left.where(near).withColumn("__part", F.pmod(F.xxhash64(*[qcol(c) for c in left.columns]), F.lit(parts)).cast("int"))
    known = known.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = [c for c in right.columns if c != right_key and c in left.columns]
    dealt = dealt.withColumnsRenamed({c: f"{c}.x" for c in both if c != key})
    known = known.withColumnsRenamed({c: f"{c}.y" for c in both}).withColumnRenamed(right_key, "__key")
    met = dealt.join(known, (F.col("__part") == F.col("__to")) & qcol(key).eqNullSafe(F.col("__key")), "left")
    return met.drop("__part", "__to", "__key").unionByName(others)


def semi_on(left: DataFrame, keys: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is among keys; null matches null."""
    return left.join(keys.select(qcol(other or key).alias("__key")), qcol(key).eqNullSafe(F.col("__key")), "left_semi")


def anti_on(left: DataFrame, keys: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not among keys; null matches null."""
    return left.join(keys.select(qcol(other or key).alias("__key")), qcol(key).eqNullSafe(F.col("__key")), "left_anti")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on all columns of the same name."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables have no column in common")
    return left.join(right, common, "left")


def taxonomy_lookup(names: DataFrame | None, ids: DataFrame, classes: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Rows (scientific_name, taxonomic_id, level columns) for the names that are known; all of them, if names is None.

    levels: only those, where there are such columns.
    """
    if names is not None:
        require_columns(names, ["scientific_name"])
        ids = semi_on(ids, names, "scientific_name")
    known = ids.join(classes, "taxonomic_id", "left")
    if levels is None:
        return known
    unknown = [x for x in levels if x not in classes.columns]
    if unknown and len(unknown) == len(levels):
        raise ValueError("no such taxonomic level: " + ", ".join(unknown))
    return known.select(*[qcol(c) for c in ("scientific_name", "taxonomic_id", *levels) if c in known.columns])


def unmatched(names: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct names that the lookup lacks."""
    return anti_on(names.select("scientific_name").distinct(), ids, "scientific_name")


def join_taxonomy(df: DataFrame, ids: DataFrame, classes: DataFrame, name: str = "scientific_name", levels: list[str] | None = None, large: bool = False) -> DataFrame:
    """df with the taxonomy of its names, df being read once. A name that the lookup has twice multiplies rows.

    large: the lookup is too large to be sent to every task, so hot names are joined apart and df is read more often.
    """
    require_columns(df, [name])
    join = left_join_split if large else left_join_suffixed
    return join(df, taxonomy_lookup(None, ids, classes, levels), name, "scientific_name")


def resolve_names(names: DataFrame, resolver: DataFrame, legacy: bool = False) -> DataFrame:
    """(name_to_evaluate, taxonomic_id, scientific_name) for every name, by a table (name, id); sorted by id, nulls last.

    Sentinels of the remote service, "Not found" and -999, count as unknown.
    """
    asked = names.select(strip_rank_suffix(F.col("scientific_name"), legacy).alias("name_to_evaluate"), "scientific_name").distinct()
    found = resolver.select(F.col("name").alias("name_to_evaluate"), F.col("id").cast("string").try_cast("bigint").alias("taxonomic_id"))
    found = found.where(F.col("taxonomic_id").isNotNull() & (F.col("taxonomic_id") != -999))
    return found.join(asked, "name_to_evaluate", "right").select("name_to_evaluate", "taxonomic_id", "scientific_name").orderBy(F.col("taxonomic_id").asc_nulls_last())


def classification(ranks: DataFrame, order: str = "ordinal", rank_names: list[str] | None = None) -> DataFrame:
    """One row for each id with a column for each rank and `level`, its last rank; ids with a rank twice are left out.

    ranks: (id, rank, scientificname, order).
    """
    ranks = ranks.withColumn("rank", F.lower("rank"))
    twice = ranks.groupBy("id", "rank").agg(F.count("*").alias("n")).where("n > 1").select("id").distinct()
    ranks = anti_on(ranks, twice, "id")
    level = ranks.groupBy("id").agg(F.max_by("rank", order).alias("level"))
    wide = ranks.groupBy("id").pivot("rank", rank_names).agg(F.first("scientificname")) if rank_names else ranks.groupBy("id").pivot("rank").agg(F.first("scientificname"))
    out = wide.join(level, "id", "left").withColumn("id", F.col("id").cast("string").try_cast("bigint")).withColumnRenamed("id", "taxonomic_id")
    return out.select("taxonomic_id", "level", *[qcol(c) for c in wide.columns if c != "id"])


def patch(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with nulls of `columns` filled from source, which has one row for each key. Values that are there stay."""
    require_columns(df, [key, *columns])
    source = source.select(qcol(key), *[qcol(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(source, key, "left")
    return joined.select(*[(F.coalesce(qcol(c), qcol(f"__new_{c}")).alias(c) if c in columns else qcol(c)) for c in df.columns])


def first_by(df: DataFrame, key: str, columns: list[str], order: Column, ignore_nulls: bool = False) -> DataFrame:
    """The first value of each column for each key in a stated order; nulls count unless ignore_nulls."""
    if not ignore_nulls:
        return df.groupBy(key).agg(F.min_by(F.struct(*[qcol(c) for c in columns]), order).alias("s")).select(key, "s.*")
    return df.groupBy(key).agg(*[F.min_by(qcol(c), F.when(qcol(c).isNotNull(), order)).alias(c) for c in columns])


def fill_metadata(df: DataFrame, store: DataFrame | KeyedStore, key: str = "sample_event_id", columns: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """Missing metadata (null or BLANK) filled from rows of the same event that were processed before; a store is read only where its keys are."""
    columns = columns or ["vis", "direction", "time", "photoquadrats"]
    df = nullif_blank(df.withColumns({c: qcol(c).cast("string") for c in columns}), columns)
    past = store.rows_of(df.select(key)) if isinstance(store, KeyedStore) else semi_on(store, df.select(key).distinct(), key)
    past = past.select(qcol(key), *[qcol(c).cast("string").alias(c) for c in columns]).distinct()
    past = nullif_blank(past, columns)
    order = order if order is not None else F.struct(*[F.struct(qcol(c).isNull(), qcol(c)) for c in columns])
    return patch(df, first_by(past, key, columns, order), key, columns)
