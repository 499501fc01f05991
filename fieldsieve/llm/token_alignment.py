"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the token pairs that overlap.

A text's tokens by tokenizer A and by tokenizer B are cut at the byte offsets where tokens of both
end. Between two neighbouring ends of either lies one overlapping pair of tokens, a link. A pair of
ids is one int64, B's id above A's. Tasks count the distinct keys of their texts (np.unique), a
range-partitioned sort brings equal keys together, and each range is written as a sorted shard of
keys and sums. A task that needs counts maps the shards that its keys fall into and searches them.

- A token table is written once and read twice; what a task holds does not grow with the corpus.
- The highest count of each B id is one long for each id of the vocabulary, which bounds it.

Defined results
- null or empty text: no tokens, so zeros and an empty digest. The same where the bytes of either
  tokenizer's tokens are not the space and the text: that holds for texts with U+2581, which B reads
  as a space.
- special tokens' strings in a text are plain text.
- null doc_id: a row like any other. Repeated rows: each counts and gets its row. Ties for a B id's
  highest count: all of them are best. An empty table: no rows. Very long texts: whole.
- further columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut
from .files import file_name, new_folder, put
from .tokens import Encoder, byte_letters, slices_of, vocabulary

#: Characters encoded at once, distinct pairs that a task holds before it sends them, and pairs of a shard file.
SLICE, MOST_KEYS, SHARD = 1_000_000, 1 << 20, 1 << 22
#: Bytes of A's ids whose links are held at once.
HELD = 500_000
SPACE_MARK = "▁"


class Pieces(Encoder):
    """Ids of a sentencepiece model whose pieces hold the space mark at their beginning alone: a unit is spaces and what follows them.

    A text is given with the space before it that the model would add.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart_by_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.pieces)
        self._forget()

    def _cut(self, body: np.ndarray, begins: np.ndarray) -> np.ndarray:
        unit = np.zeros(len(body), bool)
        if self.apart_by_space:
            unit[1:] = (body[1:] == 0x20) & (body[:-1] != 0x20)
        unit[begins] = True
        return np.flatnonzero(unit)

    def _learn(self) -> None:
        texts, self.units.new = self.units.new, []
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        if " " in texts:  # at a text's end; the model puts no space before nothing
            got[texts.index(" ")] = self.model.encode("a ")[len(self.model.encode("a")) :]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum()))])

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id."""
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]


def _kind(table) -> np.dtype:
    """What an id of a vocabulary is stored as."""
    return np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")


class Aligner:
    """Both tokenizers, with the bytes of their ids; one for each worker process."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Encoder(a, True), Pieces(b)
        letters = {c: n for n, c in byte_letters().items()}
        names = self.a.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            table[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.bytes_a, self.bytes_b = table, self.b.bytes_of()
        self.arrays = [pa.array(t, pa.large_binary()) for t in (self.bytes_a, self.bytes_b)]

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text by A and by B, packed as integers; none where they do not stand for its bytes."""
        whole = [" " + t if t else None for t in texts]
        body = [t.encode() if t else b"" for t in whole]
        ids_a, at_a = self.a(whole)
        ids_b, at_b = self.b(whole)
        same = np.array([len(x) > 0 for x in body])
        for ids, at, table in ((ids_a, at_a, self.arrays[0]), (ids_b, at_b, self.arrays[1])):
            made = table.take(pa.array(ids))
            ends = made.buffers()[1] and np.frombuffer(made.buffers()[1], np.int64, len(ids) + 1)[at]
            data = made.buffers()[2].to_pybytes() if len(ids) else b""
            if data != b"".join(body):
                same &= np.fromiter((data[x:y] == z for x, y, z in zip(ends[:-1], ends[1:], body, strict=True)), bool, len(body)) if len(ids) else False
        cut_out = lambda ids, at, table: [ids[x:y].astype(_kind(table)).tobytes() if ok else b"" for x, y, ok in zip(at[:-1], at[1:], same, strict=True)]
        return cut_out(ids_a, at_a, self.bytes_a), cut_out(ids_b, at_b, self.bytes_b)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def forget() -> None:
    """Frees what a worker has encoded with before."""
    _ALIGNERS.clear()


def lengths(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each id of A and of B stands for, for tasks that need no tokenizer."""
    it = aligner(a, b)
    sizes = tuple(np.array([len(x) for x in t], np.int32) for t in (it.bytes_a, it.bytes_b))
    forget()
    return sizes


def tokens(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a, b): the packed ids of each text by both tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, y in slices_of(texts, SLICE):
                ids_a, ids_b = align(texts[x:y])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), pa.array(ids_a, pa.binary()), pa.array(ids_b, pa.binary())], ["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, a binary, b binary")


class Links:
    """The links of some texts that stand one after another. Marks at byte offsets tell where tokens end."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], length_a: np.ndarray, length_b: np.ndarray):
        kind_a, kind_b = _kind(length_a), _kind(length_b)
        self.sizes = len(length_a), len(length_b)
        self.n_a, self.n_b = (np.array([len(x) // kind.itemsize for x in ids], np.int64) for ids, kind in ((ids_a, kind_a), (ids_b, kind_b)))
        self.a, self.b = (np.frombuffer(b"".join(ids), kind).astype(np.int64) for ids, kind in ((ids_a, kind_a), (ids_b, kind_b)))
        end_a, end_b = np.cumsum(length_a[self.a], dtype=np.int64), np.cumsum(length_b[self.b], dtype=np.int64)
        marks = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
        marks[end_a] = 1
        marks[end_b] += 2
        ends = np.flatnonzero(marks)
        self.in_a, self.in_b = (marks[ends] & 1).astype(bool), (marks[ends] & 2).astype(bool)
        #: how many tokens end up to each end
        self.upto_a, self.upto_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        self.key = self.b[self.upto_b - self.in_b] << 32 | self.a[self.upto_a - self.in_a]
        whole = np.concatenate([[0], end_a])[np.concatenate([[0], np.cumsum(self.n_a)])]
        #: where the links of each text begin, one more at the end
        self.at = np.searchsorted(ends, whole, side="right")

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """How many groups each text has, and the digest of its groups."""
        both = self.in_a & self.in_b
        upto = np.cumsum(both)
        n = np.diff(np.concatenate([[0], upto])[self.at])
        of_a, of_b = (upto - both)[self.in_a], (upto - both)[self.in_b]  # the group of each token
        # a group's tokens of A stand before its tokens of B
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.concatenate([[0], self.upto_b[both]])[of_a]] = 2 * self.a + both[self.in_a]
        codes[np.arange(len(self.b)) + self.upto_a[both][of_b]] = 2 * (self.b + self.sizes[0]) + both[self.in_b]
        text = _texts(*self.sizes).take(pa.array(codes))
        ends = np.frombuffer(text.buffers()[1], np.int64, len(codes) + 1)[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist() if len(codes) else [0] * (len(n) + 1)
        data = memoryview(text.buffers()[2]) if len(codes) else b""
        return n, [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


_TEXTS: dict[tuple[int, int], pa.Array] = {}


def _texts(size_a: int, size_b: int) -> pa.Array:
    """Ids as text: at 2 * id and 2 * id + 1 those of A, inside and at the end of a group, then those of B."""
    if (size_a, size_b) not in _TEXTS:
        _TEXTS[size_a, size_b] = pa.array([f"{i}{mark}".encode() for last, n in (("|", size_a), (";", size_b)) for i in range(n) for mark in (",", last)], pa.large_binary())
    return _TEXTS[size_a, size_b]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to `most` bytes of ids, or one row."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column("a").to_pylist()], np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def partial_counts(table: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n): the counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _pieces(batches, 4 * HELD):
            found = np.unique(Links(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *sizes).key, return_counts=True)
            keys, counts = _merged(*(np.concatenate(x) for x in zip((keys, counts), found, strict=True)))
            if len(keys) > MOST_KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return table.select("a", "b").mapInArrow(run, "key long, n long")


def write_shards(counts: DataFrame) -> tuple[str, DataFrame]:
    """The folder of sorted shards of (key, n), and (name, least, most) of each: equal keys summed by runs after a range-partitioned sort.

    A shard is its keys, then their counts, as 64-bit integers.
    """
    spark = counts.sparkSession
    folder = new_folder(spark, "pair-counts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def shard(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = file_name(part, serial)
            put(folder, name, k.astype("<i8").tobytes() + n.astype("<i8").tobytes())
            best = _best(k, n)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k[0]]), pa.array([k[-1]]), pa.array([best[0]], pa.list_(pa.int64())), pa.array([best[1]], pa.list_(pa.int64()))], ["name", "least", "most", "ids", "best"])

        for batch in batches:
            more = (batch.column("key").to_numpy(), batch.column("n").to_numpy())
            keys, sums = _merged(np.concatenate([keys, more[0]]), np.concatenate([sums, more[1]]))
            while len(keys) > SHARD:  # the last key may go on
                yield shard(keys[:SHARD], sums[:SHARD])
                keys, sums, serial = keys[SHARD:], sums[SHARD:], serial + 1
        if len(keys):
            yield shard(keys, sums)

    done = counts.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return folder, cut(done.mapInArrow(run, "name string, least long, most long, ids array<long>, best array<long>"), "shards")


def _best(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The B ids of sorted keys, and the highest count of each."""
    ids = keys >> 32
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], np.maximum.reduceat(counts, starts)


class Shards:
    """Sorted count shards in a shared folder: mapped where they are files of this machine, else one is held at a time."""

    def __init__(self, folder: str, names: list[str], least: list[int]):
        self.folder, self.names, self.least = folder, names, least

    def _open(self, name: str) -> np.ndarray:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(f"{path}/{name}", dtype="<i8", mode="r")
        with store.open_input_file(f"{path}/{name}") as file:
            return np.frombuffer(file.read(), "<i8")

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which are there."""
        out, at = np.zeros(len(keys), np.int64), 0
        while at < len(keys):
            i = bisect_right(self.least, int(keys[at])) - 1
            to = len(keys) if i + 1 == len(self.least) else int(np.searchsorted(keys, self.least[i + 1]))
            held = self._open(self.names[i])
            half = len(held) // 2
            out[at:to] = held[half:][np.searchsorted(held[:half], keys[at:to])]
            at = to
        return out


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of docs. a, b: paths of the tokenizers."""
    spark: SparkSession = docs.sparkSession
    table, sizes = cut(tokens(docs, a, b), "tokens"), lengths(a, b)
    folder, shards = write_shards(cut(partial_counts(table, sizes), "pairs"))  # written, as finding the ranges reads it too
    listed = sorted(map(tuple, shards.select("least", "name").collect()))  # a row for SHARD pairs of ids
    names, least = [n for _, n in listed], [k for k, _ in listed]
    top = shards.select(F.explode(F.arrays_zip("ids", "best")).alias("x")).groupBy("x.ids").agg(F.max("x.best").alias("best")).toArrow()  # a row for an id of B
    best = np.zeros(int(max(top.column("ids").to_pylist(), default=0)) + 1, np.int64)
    best[top.column("ids").to_numpy()] = top.column("best").to_numpy()
    shared = spark.sparkContext.broadcast(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = Shards(folder, names, least)
        for batch in _pieces(batches, HELD):
            links = Links(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *sizes)
            back, distinct = pd.factorize(links.key)
            order = np.argsort(distinct)
            counts = np.zeros(len(distinct), np.int64)
            counts[order] = held.counts(distinct[order])
            is_best = counts == shared.value[distinct >> 32]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[back])])[links.at])
            n_groups, digests = links.groups()
            columns = [links.n_a, links.n_b, n_groups, np.diff(links.at), total(is_best.astype(np.int64)), total(counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return table.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
