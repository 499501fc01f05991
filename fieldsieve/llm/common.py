"""What several operators share: word splitting and scratch tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words, in Java's regular expressions and in Python's.
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode (tests), where none is named, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/fieldsieve-{name}-{uuid.uuid4().hex}"


#: Where cut() notes what it writes, while a caller owns it.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The folders of the tables that cut() writes inside, in this thread: the caller's, to drop() once all that came of them is written."""
    paths: list[str] = []
    before = _OWNED.set(paths)
    try:
        yield paths
    finally:
        _OWNED.reset(before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if (paths := _OWNED.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by their folders, which owned() gave; those that are gone already don't matter."""
    for folder in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing needs any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/fieldsieve-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
