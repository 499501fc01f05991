"""Lookups of a remote taxonomic service, through a client that the caller gives; none is called here on its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldsieve.sources.files import existing
from fieldsieve.sources.scratch import written


def lookup(names: DataFrame, client: Callable[[list[str]], dict[str, str]], column: str = "scientific_name") -> DataFrame:
    """(name, id): the client is asked for each batch of distinct names inside tasks; names it lacks are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = client(batch["name"].tolist())
            yield pd.DataFrame([(n, str(i)) for n, i in found.items()], columns=["name", "id"])

    return names.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct().mapInPandas(run, "name string, id string")


def ranks(ids: DataFrame, client: Callable[[str], list[tuple[str, str]]], column: str = "taxonomic_id") -> DataFrame:
    """(id, ordinal, rank, scientificname) of each distinct id, coarse to fine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, rank, name) for i in batch["id"] for k, (rank, name) in enumerate(client(i))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "rank", "scientificname"])

    return ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct().mapInPandas(run, "id string, ordinal int, rank string, scientificname string")


def lookup_kept(names: DataFrame, client: Callable[[list[str]], dict[str, str]], kept: str, column: str = "scientific_name", attempts: int = 3, batch: int = 100) -> DataFrame:
    """lookup() with a table of answers in the folder `kept`: a name is asked for once, ever, an unknown one included.

    A batch of names that fails is asked for again up to `attempts` times. What was answered is kept
    even if other batches fail for good, which raises an error; asking again asks for these alone.
    """
    spark = names.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for at in range(0, len(some), batch):
                asked = some["name"].tolist()[at : at + batch]
                found, error = {}, None
                for _ in range(attempts):
                    try:
                        found, error = client(asked), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the service raises
                        error = repr(e)
                yield pd.DataFrame([(n, None if found.get(n) is None else str(found[n]), error) for n in asked], columns=["name", "id", "error"])

    asked = names.select(F.col(column).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    missing = asked
    if existing(spark, [kept]):
        missing = asked.join(spark.read.schema("name string, id string").parquet(kept), "name", "left_anti")
    answers = written(missing.mapInPandas(run, "name string, id string, error string"), "answers")  # so that nothing is asked for twice
    answers.where("error IS NULL").select("name", "id").write.mode("append").parquet(kept)
    failed = answers.where("error IS NOT NULL").agg(F.count("*"), F.min("error")).first()
    if failed[0]:
        raise RuntimeError(f"{failed[0]} names could not be looked up ({failed[1]}); the answers to the others are kept")
    return spark.read.schema("name string, id string").parquet(kept).where("id IS NOT NULL").join(asked, "name", "left_semi")
