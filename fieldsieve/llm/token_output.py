"""Token ids of a corpus in compressed binary files, and back.

A file holds some documents of one range of doc_id in ascending order:
magic "FSCM" and version 2; document count; for each document a flag (doc_id is null), doc_id and
its id count; block count; for each block its id count, byte count and the CRC-32 of its ids;
then the blocks' bytes (see coder.py). Numbers are little-endian. Every block is coded and
checked independently of the others. A task starts a new file after `FILE_IDS` ids.

Defined results
- null or empty text: the end id alone. null doc_id: first in order. Repeated rows: each is
  written. Order among equal doc_ids is by xxhash64 of the text, then by the text itself.
- very long texts: a document is in one file, in as many blocks as it needs.
- an empty table: no files, no rows. Further columns don't matter here, whatever their names.
- a block whose checksum differs raises ValueError with the file's name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .coder import decode, encode
from .common import cut
from .files import offsets, read_files, write_sorted
from .tokens import encoder, slices_of, vocabulary

#: Ids in a block and, about, in a file.
BLOCK, FILE_IDS = 1 << 20, 1 << 24
END = 0
#: Characters of text that are encoded at once.
SLICE = 6_000_000
HEAD = struct.Struct("<4sII")


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of the ids of some documents, one after another."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded = [encode(b) for b in blocks]
    table = np.array([(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True)], "<u4").reshape(-1, 3)
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(b"FSCM", 2, len(doc_ids)), null.tobytes(), numbers.tobytes(), lengths.astype("<u4").tobytes(), struct.pack("<I", len(blocks)), table.tobytes(), *coded])


def from_bytes(data: bytes, name: str = "") -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What to_bytes() was given."""
    magic, version, n = HEAD.unpack_from(data)
    if magic != b"FSCM" or version != 2:
        raise ValueError(f"not a file of this format: {name}")
    at = HEAD.size
    null = np.frombuffer(data, np.uint8, n, at)
    numbers = np.frombuffer(data, "<i8", n, at := at + n)
    lengths = np.frombuffer(data, "<u4", n, at := at + 8 * n)
    (count,) = struct.unpack_from("<I", data, at := at + 4 * n)
    table = np.frombuffer(data, "<u4", 3 * count, at := at + 4).reshape(-1, 3)
    ends = at + 12 * count + np.cumsum(table[:, 1].astype(np.int64))
    blocks = [decode(data[e - int(n) : e]) for e, n in zip(ends, table[:, 1], strict=True)]
    for b, (_, _, crc) in zip(blocks, table, strict=True):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError(f"a block differs from its checksum: {name}")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    return [None if z else int(d) for z, d in zip(null, numbers, strict=True)], lengths, ids


def write(docs: DataFrame, path: str, spaced: bool = True, end: int = END) -> str:
    """Files of all documents' ids in ascending doc_id order; the folder they are in."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        encode_texts = encoder(path, spaced)
        doc_ids: list[int | None] = []
        parts, lengths, size = [], [], 0

        def flush() -> bytes:
            out = to_bytes(doc_ids, np.concatenate(lengths), np.concatenate(parts))
            doc_ids.clear(), parts.clear(), lengths.clear()
            return out

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices_of(texts, SLICE):
                ids, starts = encode_texts(texts[a:b], end)
                doc_ids += keys[a:b]
                parts.append(ids.astype(np.uint32)), lengths.append(np.diff(starts))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    size = 0
        if doc_ids:
            yield flush()

    return write_sorted(docs.select(F.col("doc_id").cast("long"), "text"), "tokens", make)


def read(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; with_ids adds the packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                doc_ids, lengths, ids = from_bytes(content.as_py(), path)
                ends = np.cumsum(lengths.astype(np.int64))
                packed = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array([path] * len(packed), pa.string()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in packed], pa.int64())]
                names = ["path", "doc_id", "inside", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(packed, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    rows = read_files(spark, folder).mapInArrow(run, "path string, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    rows = cut(rows, "ids")
    out = rows.join(offsets(rows, "path", F.col("n_tokens")), "path")
    return out.select("doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    folder = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
    return read(spark, folder)
