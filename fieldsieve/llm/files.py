"""Binary files of our own in the shared folder, written inside tasks and read by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import scratch_path


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that a task that is lost or runs twice leaves no part of one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    # a name that Spark's readers pass over
    hidden = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    try:
        store.move(hidden, f"{path}/{name}")
    except OSError:  # some stores don't replace what another run of the task has put there
        if store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        store.delete_file(hidden)


def new_folder(spark: SparkSession, name: str) -> str:
    folder = scratch_path(spark, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # an empty table has no files
    return folder


def file_name(part: int, serial: int) -> str:
    """Names in the order of partitions and, inside them, of files."""
    return f"part-{part:08d}-{serial:06d}.bin"


def write_sorted(docs: DataFrame, name: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]) -> str:
    """The folder of files that make() yields from (doc_id, text) in ascending order; equal ids by a hash of the text, then the text.

    A task writes as many files as make() yields, one after another, so none is held for longer than it is made.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), -1
        for serial, data in enumerate(make(batches)):
            put(folder, file_name(part, serial), data)
        yield pa.RecordBatch.from_arrays([pa.array([serial + 1])], ["files"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    done = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    done.mapInArrow(run, "files long").agg(F.sum("files")).first()
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of each file, in Spark's own reader."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def offsets(sizes: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, before): the sum of size over all lesser keys. One row for each file or block comes in."""
    total = sizes.groupBy(key).agg(F.sum(size).alias("__n"))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return total.select(key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("before"))
