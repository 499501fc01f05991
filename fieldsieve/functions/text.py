"""Names and other short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def canonical_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores for spaces."""
    return df.toDF(*[c.replace(" ", "_").lower() for c in df.columns])


def strip_rank_suffix(name: Column, legacy: bool = False) -> Column:
    """A scientific name without a closing ` sp.` or ` spp.`; legacy: by patterns whose dot is any character, everywhere."""
    if not legacy:
        return F.regexp_replace(name, r"\s+spp?\.$", "")
    one, many = " sp.", " spp."
    return F.when(name.rlike(one + "$"), F.regexp_replace(name, one, "")).when(name.rlike(many + "$"), F.regexp_replace(name, many, "")).otherwise(name)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def remove_first(text: Column, part: str) -> Column:
    """text without the first occurrence of a literal part."""
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(part), F.length(text)))).otherwise(text)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; null if they make none."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))
