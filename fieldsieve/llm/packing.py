"""Vector bin packing of examples into training sequences.

An example asks for tokens, one segment and its loss-bearing tokens; a sequence has a limit on
each. A sequence is filled by taking, again and again, the example that still fits and whose
demand has the largest dot product with what is left, both as shares of the limits. Where
documents may be cut, whole sequences' worth of a long one is cut off first, and the emptiest
sequences of a chunk are then dealt out over the gaps of the others. Each task packs chunks of
its own rows: nothing is shuffled, and one sequence in a chunk is not full.

Defined results
- null or empty text: the end id alone. null doc_id: packed like any other. Repeated rows:
  each is packed. Ties: of equal dot products the larger example goes first, of equal examples
  the earlier. Very long texts fill whole sequences. An empty table: no rows.
- further columns don't matter here, whatever their names; null prompts are empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tokens import encoder, slices_of, vocabulary

LENGTH = 2048
MOST_SEGMENTS = 256
END = 1
#: Characters of text that make a chunk; a row counts as some, so that tiny ones don't make one endless.
CHUNK, ROW = 6_000_000, 150
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of demand in bins within limits, by the dot-product heuristic; a row over the limits is an error."""
    if (demand > limits).any():
        raise ValueError("an example asks for more than a sequence holds")
    if not len(demand):
        return []
    # equal demands are one class, so that a chunk of many small examples is quick
    kinds, of, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(count)[:-1])
    order = np.argsort(-(kinds / limits).sum(axis=1), kind="stable")
    kinds, count, members = kinds[order], count[order], [members[i] for i in order]
    share, at, bins = kinds / limits, np.zeros(len(kinds), np.int64), []
    while (left := np.flatnonzero(at < count)).size:
        room, held = limits.astype(float), []
        rest = left
        while True:
            rest = rest[(at[rest] < count[rest]) & (kinds[rest] <= room).all(axis=1)]
            if not len(rest):
                break
            best = rest[np.argmax(share[rest] @ (room / limits))]
            take = 1
            if len(rest) == 1:  # nothing else fits, now or later
                fit = np.floor(room[kinds[best] > 0] / kinds[best][kinds[best] > 0]).min(initial=count[best])
                take = int(min(fit, count[best] - at[best]))
            held += members[best][at[best] : at[best] + take].tolist()
            at[best] += take
            room = room - take * kinds[best]
        bins.append(held)
    return bins


def cut_and_place(lengths: list[int], loss: list[int] | None = None, length: int = LENGTH, most_segments: int = MOST_SEGMENTS, most_loss: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, tokens) of examples that may be cut.

    loss: how many of an example's last tokens bear loss; all of them, if not given.
    """
    most_loss = most_loss or length
    loss = lengths if loss is None else loss
    bears = lambda i, start, n: max(0, min(n, start + n - (lengths[i] - loss[i])))
    whole, rest = [], []
    step = min(length, most_loss)
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= step:
            whole.append([(i, at, step)])
            at += step
        if n > at:
            rest.append((i, at, n - at))
    demand = np.array([(n, 1, bears(i, at, n)) for i, at, n in rest], dtype=float).reshape(-1, 3)
    bins = [[rest[j] for j in b] for b in place(demand, np.array([length, most_segments, most_loss], dtype=float))]
    room = lambda b: (length - sum(n for *_, n in b), most_segments - len(b), most_loss - sum(bears(*x) for x in b))
    bins.sort(key=lambda b: -sum(n for *_, n in b))
    first, last = 0, len(bins) - 1
    while first < last:
        tokens, segments, losses = room(bins[first])
        take = min(tokens, losses)
        if take <= 0 or segments <= 0:
            first += 1
            continue
        i, at, n = bins[last].pop()
        if n <= take:
            bins[first].append((i, at, n))
        else:
            bins[first].append((i, at + n - take, take))
            bins[last].append((i, at, n - take))
        if not bins[last]:
            last -= 1
    return whole + [b for b in bins if b]


def packed(docs: DataFrame, path: str, spaced: bool, end: int = END, length: int = LENGTH, most_segments: int = MOST_SEGMENTS, with_ids: bool = False, prompt: str | None = None, most_loss: int | None = None) -> DataFrame:
    """A row for each piece, as SCHEMA says; with_ids adds the piece's ids, packed as little-endian unsigned 32-bit.

    path, spaced: the tokenizer's file, and whether its ids hold white space. prompt: a column of
    text before each text whose tokens bear no loss. most_loss: loss-bearing tokens in a sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(path, spaced), TaskContext.get().partitionId() << 40
        held_ids: list = []
        held: list[np.ndarray] = []
        loss: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7 + with_ids)]
            for pieces in cut_and_place([len(x) for x in held], loss, length, most_segments, most_loss):
                offset = 0
                for i, at, n in pieces:
                    ids = held[i][at : at + n].astype("<u4").tobytes()
                    row = (held_ids[i], at, n, zlib.crc32(ids), len(held[i]), sequence, offset, ids)
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
                    offset += n
                sequence += 1
            held.clear(), held_ids.clear(), loss.clear()
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices_of(texts, CHUNK):
                ids, starts = encode(texts[a:b], end)
                own = [ids[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
                loss += map(len, own)
                if prompt is not None:
                    before = batch.column("__prompt").slice(a, b - a).to_pylist()
                    ids, starts = encode(before)
                    own = [np.concatenate([ids[x:y], t]) for x, y, t in zip(starts[:-1], starts[1:], own, strict=True)]
                    size += sum(len(t) if t else 0 for t in before)
                held += own
                held_ids += keys[a:b]
                size += sum(len(t) if t else 0 for t in texts[a:b]) + ROW * (b - a)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    before = [F.col(prompt).alias("__prompt")] if prompt is not None else []
    return docs.select(F.col("doc_id").cast("long"), "text", *before).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def exchanges(conversations: DataFrame) -> DataFrame:
    """(doc_id, prompt, text): each assistant's turn with the turn before it, as instruction data; doc_id is conv_id."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select(F.col("conv_id").alias("doc_id"), "role", "text", F.lag("text").over(by).alias("prompt"))
    return rows.where("role = 'assistant'").select("doc_id", "prompt", "text")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), False)
