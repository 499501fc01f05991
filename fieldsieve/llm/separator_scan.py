"""Token counts of documents in flat unindexed token files, by a scan for the end-of-document id.

The files hold ids and nothing else, so where documents begin is only known by the end ids.
Each task looks through blocks of its files in numpy: a block gives its end ids, the ids before
its first one (the tail of a document of an earlier block) and those after its last one. A
prefix sum over blocks stitches them: how many documents end before a block, and where the
document that is open at its start began.

Defined results
- ids after the last end id of all files: a last document without an end, n_tokens counts them.
- an end id right after another: a document of that one id. No files or empty files: no rows.
- null or empty text, when files are written: the end id alone. null doc_id and repeated rows:
  documents like any other. Order is that of the table's partitions, so nothing is shuffled.
- very long texts: a document may cover many blocks; it lies in one file when it is written here.
- further columns don't matter here, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut
from .files import file_name, new_folder, offsets, put, read_files
from .tokens import encoder, slices_of, vocabulary

END = 50256
#: Ids in a block.
BLOCK = 1 << 16
#: Ids after which a task starts a new file.
FILE_IDS = 1 << 25


def width(path: str, spaced: bool) -> str:
    """How ids of a tokenizer are stored: 16 bits, where all of them fit."""
    return "<u2" if encoder(path, spaced).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str, spaced: bool = True, end: int = END) -> tuple[str, DataFrame]:
    """The folder of files of little-endian ids and nothing else, and (file, place, doc_id) of each document in them.

    If a task runs again, it must get its rows in the same order, as it does from files.
    """
    folder, kind = new_folder(docs.sparkSession, "flat"), width(path, spaced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, serial = encoder(path, spaced), TaskContext.get().partitionId(), 0
        parts, keys, size = [], [], 0

        def flush() -> pa.RecordBatch:
            name = file_name(part, serial)
            put(folder, name, b"".join(parts))
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(np.arange(len(keys))), pa.array(keys, pa.int64())], ["file", "place", "doc_id"])
            parts.clear(), keys.clear()
            return out

        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices_of(texts, 2_000_000):
                ids = encode(texts[a:b], end)[0]
                parts.append(ids.astype(kind).tobytes())
                keys += own[a:b]
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    serial, size = serial + 1, 0
        if keys:
            yield flush()

    return folder, cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, place long, doc_id long"), "places")


def scan(spark: SparkSession, folder: str, end: int = END, kind: str = "<u4") -> DataFrame:
    """(ordinal, start, n_tokens) of every document in the files, in the order of the files' names.

    start counts ids of all files; n_tokens holds the end id. kind: numpy's name of how ids are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), kind)
                rows = [(path, at // BLOCK, len(x := ids[at : at + BLOCK]), np.flatnonzero(x == end)) for at in range(0, len(ids), BLOCK)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([x.astype(np.int32) for x in columns[3]], pa.list_(pa.int32()))], ["path", "block", "size", "ends"])

    blocks = read_files(spark, folder).mapInArrow(run, "path string, block long, size long, ends array<int>")
    blocks = cut(blocks, "blocks")
    # the prefix scan, in two levels: over the files, and over the blocks of each file
    sums = blocks.select("path", "block", "size", F.size("ends").cast("long").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    inside = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.withColumn("at", F.coalesce(F.sum("size").over(inside), zero)).withColumn("docs", F.coalesce(F.sum("n").over(inside), zero))
    files = offsets(sums, "path", F.col("size")).withColumnRenamed("before", "file_at")
    counts = offsets(sums, "path", F.col("n")).withColumnRenamed("before", "file_docs")
    sums = sums.join(files, "path").join(counts, "path").withColumn("at", F.col("at") + F.col("file_at")).withColumn("docs", F.col("docs") + F.col("file_docs"))
    # where the document that is open at the block's start began: after the last end of an earlier block
    sums = cut(sums.withColumn("after", F.col("at") + F.col("last") + 1), "sums")
    in_file = F.max("after").over(inside)
    ends = sums.groupBy("path").agg(F.max("after").alias("m"))
    earlier = ends.select("path", F.coalesce(F.max("m").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("earlier"))
    sums = sums.withColumn("open", in_file).join(earlier, "path").withColumn("open", F.coalesce("open", "earlier"))
    stitched = blocks.select("path", "block", "ends").join(sums.select("path", "block", "at", "docs", "open"), ["path", "block"])
    rows = stitched.select("at", "docs", "open", "ends", F.posexplode("ends").alias("i", "e"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1)
    done = rows.select((F.col("docs") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("e") + 1 - start).alias("n_tokens"))
    whole = sums.agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("after"), zero).alias("start"), F.sum("size").alias("size"))
    tail = whole.where(F.col("size") > F.col("start")).select("ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"))
    return done.union(tail)


def op2_separator_scan(spark, sf_dir: str) -> DataFrame:
    """(ordinal, start, n_tokens, doc_id): the scan's documents, named by the order in which they were written."""
    path = vocabulary("byte_bpe_50k.json")
    folder, places = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = scan(spark, folder, kind=width(path, True))
    named = places.join(offsets(places, "file", F.lit(1)), "file").select("doc_id", (F.col("place") + F.col("before")).alias("ordinal"))
    return found.join(named, "ordinal").select("doc_id", "ordinal", "start", "n_tokens")
