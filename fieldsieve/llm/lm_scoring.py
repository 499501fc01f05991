"""Language-model scores by deleted interpolation.

p(w | h) = l0(b) / (V + 1) + l1(b) * c(w) / N + l2(b) * c(h w) / c(h), where b is the bucket of
the context's frequency c(h). Counts come from all training documents. The weights of each
bucket are learned by expectation-maximisation on held-out counts: one fold of the training
documents is deleted from the counts and its tokens are predicted from the rest.

Documents are dealt into blocks, written once. Each block sends its distinct words and word
pairs with their counts, packed and sorted, to the range of hashes they fall in; there they are
summed over all blocks and the sums go back to the block. So nothing but packed counts is
shuffled, a frequent pair comes once from each block, and no count table meets in one place.

Defined results
- very long texts: a block is at least one document, however long. Ties and further columns,
  whatever their names, don't matter here. An empty table: no rows.
- null or empty text: the end token alone. null doc_id: its text as a number is empty, so it trains.
- repeated rows: each is trained on and scored. No training documents: N = V = 0, scores are the
  uniform ones. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .shingles import MULTIPLIER, mixed, word_hashes

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text in a block.
BLOCK = 4_000_000
#: Frequency buckets: none, then by powers of two.
BUCKETS = 32
ROUNDS = 30
#: Steps of an octave that probabilities are rounded to for the weights alone.
STEPS = 4
END, BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_ZSTD = pa.Codec("zstd", compression_level=1)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _pack(a: np.ndarray) -> bytes:
    data = a.tobytes()
    return len(data).to_bytes(8, "little") + (_ZSTD.compress(data, asbytes=True) if data else b"")


def _unpack(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(_ZSTD.decompress(data[8:], size, asbytes=True), dtype) if size else np.zeros(0, dtype)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, deleted, ids, known, sizes, body): documents packed by the deleted fold and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[bool, tuple[list, list, list]] = {True: ([], [], []), False: ([], [], [])}
        sizes = {True: 0, False: 0}

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal block
            ids, bodies, _ = held[kind]
            known = np.array([i is not None for i in ids], np.uint8)
            row = {"block": [block], "deleted": [kind], "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "known": [known.tobytes()], "sizes": [np.array([len(b) for b in bodies], np.int64).tobytes()], "body": [_pack(np.frombuffer(b"".join(bodies), np.uint8))]}
            block += 1
            ids.clear(), bodies.clear()
            sizes[kind] = 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), *[(c, pa.binary()) for c in ("ids", "known", "sizes", "body")]]))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kind, body = fold_of(doc_id) == DELETED, (text or "").encode()
                held[kind][0].append(doc_id), held[kind][1].append(body)
                sizes[kind] += len(body) + 16
                if sizes[kind] >= BLOCK:
                    yield flush(kind)
        for kind in (True, False):
            if held[kind][0]:
                yield flush(kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, deleted boolean, ids binary, known binary, sizes binary, body binary")


class _Tokens:
    """The tokens of one block: words and, after each document, its end."""

    def __init__(self, row: dict):
        known = np.frombuffer(row["known"], np.uint8)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(row["ids"], np.int64), known, strict=True)]
        sizes, body = np.frombuffer(row["sizes"], np.int64), _unpack(row["body"], np.uint8).tobytes()
        ends = np.cumsum(sizes)
        hashes, starts = word_hashes([body[e - n : e].decode() for e, n in zip(ends, sizes, strict=True)])
        self.counts = np.diff(starts) + 1
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.word = np.insert(mixed(hashes), starts[1:], END)
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[self.starts[:-1]] = BEGIN
        one = np.uint64(1)
        self.pair = mixed(context * MULTIPLIER + self.word) & ~one  # even: pairs; odd: words
        self.single = self.word | one
        self.folds = np.array([fold_of(i) for i in self.ids])
        self.keys, self.at = np.unique(np.concatenate([self.single, self.pair]), return_inverse=True)

    def edges(self, buckets: int) -> np.ndarray:
        """Where the keys of each bucket, a range of hashes, begin."""
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, bounds), [len(self.keys)]])


def _sent(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _Tokens(row)
                fold = np.repeat(t.folds, t.counts)
                train, gone = (np.bincount(t.at, np.concatenate([x, x]), len(t.keys)).astype(np.uint32) for x in (fold != HELD_OUT, fold == DELETED))
                e = t.edges(buckets)
                some = np.flatnonzero(np.diff(e))
                columns = [pa.array(some.astype(np.int32)), pa.array([row["block"]] * len(some), pa.int64())]
                columns.append(pa.array([t.keys[e[i] : e[i + 1]].tobytes() for i in some], pa.binary()))
                columns += [pa.array([_pack(x[e[i] : e[i + 1]]) for i in some], pa.binary()) for x in (train, gone)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "train", "gone"])

    return blocks.mapInArrow(run, "bucket int, block long, keys binary, train binary, gone binary")


def _answered(sent: DataFrame) -> DataFrame:
    """(block, bucket, train, gone, distinct): sums over all blocks for the keys that each block sent; distinct: words trained on."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        train, gone = (np.bincount(at, np.concatenate([_unpack(r[c], np.uint32) for r in rows]), len(found)).astype(np.uint32) for c in ("train", "gone"))
        words = int(np.count_nonzero((found & np.uint64(1)).astype(bool) & (train > 0)))
        out = [[r["block"] for r in rows], [r["bucket"] for r in rows]]
        out += [[_pack(x[at[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)] for x in (train, gone)]
        out.append([words] + [0] * (len(rows) - 1))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["block", "bucket", "train", "gone", "distinct"])

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, train binary, gone binary, distinct long")


class _Counts:
    """For each token of a block: c(w), c(h w) and c(h), in training or without the deleted fold."""

    def __init__(self, t: _Tokens, answers: list[dict], documents: tuple[int, int]):
        answers = sorted(answers, key=lambda r: r["bucket"])
        train, gone = (np.concatenate([_unpack(r[c], np.uint32) for r in answers]).astype(np.int64)[t.at] for c in ("train", "gone"))
        n = len(t.word)
        self.all = self._of(t, train[:n], train[n:], documents[0])
        self.rest = self._of(t, (train - gone)[:n], (train - gone)[n:], documents[0] - documents[1])

    @staticmethod
    def _of(t: _Tokens, word: np.ndarray, pair: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[t.starts[:-1]] = documents
        return word, pair, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 2), 0)


def weights_of(cells: list[tuple[int, int, int, int]], distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, order) by expectation-maximisation over counted cells (bucket, step of p1, step of p2, tokens).

    A step s stands for 2 ** (-s / STEPS), and -1 for a probability of 0.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0.5, 0.5, 0.0)
    if not cells:
        return out
    bucket, p1, p2, n = (np.array(c, np.float64) for c in zip(*cells, strict=True))
    bucket = bucket.astype(int)
    p = np.stack([np.full(len(n), 1 / (distinct + 1)), *[np.where(x < 0, 0.0, 2.0 ** (-x / STEPS)) for x in (p1, p2)]], axis=1)
    for _ in range(rounds):
        share = out[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.zeros((BUCKETS, 3))
        np.add.at(sums, bucket, share)
        sums += out * 0.5  # so that a bucket with few held-out tokens stays near where it was
        out = sums / sums.sum(axis=1, keepdims=True)
    out = np.maximum(out, [1e-6, 1e-6, 0.0])
    return out / out.sum(axis=1, keepdims=True)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each of docs."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(_blocks(docs), "blocks")
    answers = cut(_answered(_sent(blocks, buckets)), "answers")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8)
                folds = np.array([fold_of(int(i) if k else None) for i, k in zip(ids, known, strict=True)])
                sizes, body = np.frombuffer(row["sizes"], np.int64), _unpack(row["body"], np.uint8).tobytes()
                ends = np.cumsum(sizes)
                words = np.array([len(body[e - n : e].split()) + 1 for e, n in zip(ends, sizes, strict=True)], np.int64)
                train, gone = folds != HELD_OUT, folds == DELETED
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (words[train].sum(), train.sum(), words[gone].sum(), gone.sum())], ["n", "docs", "gone", "gone_docs"])

    n, documents, gone, gone_documents = (int(x or 0) for x in blocks.mapInArrow(totals, "n long, docs long, gone long, gone_docs long").agg(*[F.sum(c) for c in ("n", "docs", "gone", "gone_docs")]).first())
    both = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "train", "gone")).alias("answers"))  # one row a bucket

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, pair, context = _Counts(_Tokens(row), row["answers"], (documents, gone_documents)).rest
                step = lambda a, b: np.where(a > 0, np.round(-STEPS * np.log2(np.maximum(a, 1) / np.maximum(b, 1))), -1).astype(np.int64)
                cells = np.stack([_bucket(context), step(word, n - gone), step(pair, context)], axis=1)
                cells, count = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells.T.copy(), count)], ["b", "p1", "p2", "n"])

    cells = blocks.where("deleted").join(both, "block").mapInArrow(observed, "b long, p1 long, p2 long, n long")
    # bounded by buckets and steps, whatever the corpus
    cells = cells.groupBy("b", "p1", "p2").agg(F.sum("n").alias("n")).collect()
    weights = weights_of([tuple(r) for r in cells], distinct)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _Tokens(row)
                word, pair, context = _Counts(t, row["answers"], (documents, gone_documents)).all
                w = weights[_bucket(context)]
                p = w[:, 0] / (distinct + 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * pair / np.maximum(context, 1)
                each = lambda x: np.add.reduceat(x, t.starts[:-1])
                base = each(np.log10((word + 1) / (n + distinct + 1)))
                arrays = [pa.array(t.ids, pa.int64()), pa.array(t.folds == HELD_OUT), pa.array(t.counts), pa.array(each((word > 0).astype(np.int64))), pa.array(np.full(len(t.ids), n)), pa.array(base), pa.array(each(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.join(both, "block").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
