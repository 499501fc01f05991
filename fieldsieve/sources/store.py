"""Rows that were processed before, kept so that a batch reads only what its keys can match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldsieve.functions.nulls import qcol
from fieldsieve.sources.scratch import written

#: The folder of a row: a hash of its key, of so many.
FOLDER, FOLDERS = "__folder", 64
#: Up to so many keys are named in the scan; of more, the range.
MOST_NAMED = 1000


def _folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class KeyedStore:
    """Parquet in folders by a hash of the key, in them sorted by the key, so that keys rule out folders, files and row groups.

    A hot key's rows are dealt to several files. Rows without a key are kept, but no batch asks for them.
    """

    spark: SparkSession
    path: str
    key: str

    def append(self, df: DataFrame) -> None:
        rows = df.withColumn(FOLDER, _folder(qcol(self.key)))
        order = [FOLDER, qcol(self.key)]
        rows.repartitionByRange(*order, F.xxhash64(*[qcol(c) for c in df.columns])).sortWithinPartitions(*order).write.mode("append").partitionBy(FOLDER).parquet(self.path)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among those of `keys`, a table with a column of that name.

        One job on the distinct keys finds their folders, their range and, while they are at most
        MOST_NAMED, the keys themselves; these are filters of the scan. A semi-join makes it exact.
        """
        stored = self.spark.read.parquet(self.path)
        key = qcol(self.key)
        wanted = written(keys.select(key.cast(stored.schema[self.key].dataType).alias(self.key)).where(key.isNotNull()).distinct(), "wanted")
        about = wanted.agg(F.count("*").alias("n"), F.collect_set(_folder(key)).alias("folders"), F.min(key).alias("least"), F.max(key).alias("greatest")).first()
        if not about["n"]:
            return stored.where(F.lit(False)).drop(FOLDER)
        if about["n"] <= MOST_NAMED:
            among = key.isin([r[0] for r in wanted.collect()])
        else:
            among = key.between(about["least"], about["greatest"])
        near = stored.where(F.col(FOLDER).isin(sorted(about["folders"])) & among).drop(FOLDER)
        return near.join(wanted, self.key, "left_semi").select(*[qcol(c) for c in near.columns])
