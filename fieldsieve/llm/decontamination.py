"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case and without ASCII punctuation. Seeds are runs of `MIN_MATCH` words. A bitmap of the benchmark's seeds (its size is fixed,
whatever the benchmark) passes over every document; what hits it is joined with the seeds
exactly. A pair that shares enough seeds to reach the threshold is tiled: the longest match
of words that no tile covers yet becomes a tile, again and again, down to `MIN_MATCH` words.
Matches are found by rolling Karp-Rabin hashes and compared word by word. The share of the
item's words under tiles decides, wherever the tiles stand, so reordered passages are caught.

Defined results
- null or empty text of a document or item: matches nothing.
- items of fewer than `MIN_MATCH` words are not searched for.
- null doc_id: compared like any other; its row in the result has doc_id null.
- ties: of matches of equal length the one that begins first in the document becomes a tile first.
- very long texts: searched whole; work grows with their length. An empty table, or a benchmark
  without items, gives no rows. Further columns, whatever their names, are kept as they are.
- repeated rows (one doc_id, equal text) give one row for each item; equal doc_id with other
  text gives rows of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bitmaps import bitmap, hits
from .common import cut
from .shingles import slices, split, windows, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5


def tiles(doc: list[bytes], item: list[bytes], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, words), longest first."""
    ids: dict[bytes, int] = {}
    p = np.array([ids.setdefault(w, len(ids)) for w in item], dtype=np.uint64)
    d = np.array([ids.get(w, len(ids)) for w in doc], dtype=np.uint64)
    if len(p) < least or len(d) < least:
        return []
    hp, hd = windows(p, least), windows(d, least)
    at: dict[int, list[int]] = {}
    for j, h in enumerate(hp.tolist()):
        at.setdefault(h, []).append(j)
    hits = np.flatnonzero(np.isin(hd, hp))
    heap = []
    for i in hits.tolist():
        for j in at[int(hd[i])]:
            if i and j and d[i - 1] == p[j - 1]:
                continue  # inside a longer match
            most = min(len(d) - i, len(p) - j)
            differ = np.flatnonzero(d[i : i + most] != p[j : j + most])
            n = int(differ[0]) if len(differ) else most
            if n >= least:
                heap.append((-n, i, j))
    heapq.heapify(heap)
    in_doc, in_item, out = np.zeros(len(d), bool), np.zeros(len(p), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[i : i + n] | in_item[j : j + n])
        if free.all():
            in_doc[i : i + n] = in_item[j : j + n] = True
            out.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _seeds(benchmark: DataFrame, least: int) -> DataFrame:
    """(seed, item_id, places, words): the seeds of each item, how often each stands in it, and the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts = word_hashes(batch.column("text").to_pylist(), plain=True)
            every, rows = windows(hashes, least), []
            for item, a, b in zip(batch.column("item_id").to_pylist(), starts[:-1], starts[1:], strict=True):
                if b - a >= least:
                    seed, n = np.unique(every[a : b - least + 1], return_counts=True)
                    rows += [(s, item, c, int(b - a)) for s, c in zip(seed.view(np.int64).tolist(), n.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seed", "item_id", "places", "words"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "seed long, item_id long, places long, words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """(__key, doc_id, item_id, item_words, covered, tiles, coverage) of each document and item that reach `coverage`.

    __key names the row of docs: a hash of its doc_id and text.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("__key"), F.col("doc_id"), "text")
    seeds = cut(_seeds(benchmark, least), "seeds")
    bits = spark.sparkContext.broadcast(bitmap(seeds, F.col("seed")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in slices(batches):
            hashes, starts = word_hashes(batch.column("text").to_pylist(), plain=True)
            every = windows(hashes, least)
            hit = np.flatnonzero(hits(table, every.view(np.int64)))
            doc = np.searchsorted(starts, hit, side="right") - 1
            inside = hit + least <= starts[doc + 1]
            doc, seed = doc[inside], every[hit[inside]]
            if len(doc):
                doc, seed = np.unique(np.stack([doc.astype(np.uint64), seed], axis=1), axis=0).T
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(doc.astype(np.int64))), pa.array(np.ascontiguousarray(seed, dtype=np.uint64).view(np.int64), pa.int64())], ["__key", "seed"])

    met = keyed.select("__key", "text").mapInArrow(probe, "__key long, seed long").join(seeds, "seed")
    # a tile of n words holds n - least + 1 seeds, so at least one in `least` of the words under it begins one
    near = met.dropDuplicates(["__key", "item_id", "seed"]).groupBy("__key", "item_id").agg(F.sum("places").alias("n"), F.first("words").alias("words"))
    near = near.where(F.col("n") * least >= F.lit(coverage) * F.col("words")).select("__key", "item_id")
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    items = near.join(texts, "item_id").groupBy("__key").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    items = cut(items, "candidates")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("__key", "doc_id", "text", "items")), strict=True):
                doc = split(text, plain=True)
                for x in found:
                    item = split(x["item"], plain=True)
                    parts = tiles(doc, item, least)
                    covered = sum(n for _, _, n in parts)
                    if item and covered >= coverage * len(item):
                        rows.append((key, doc_id, x["item_id"], len(item), covered, len(parts)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["__key", "doc_id", "item_id", "item_words", "covered", "tiles"])

    joined = keyed.join(items, "__key").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = joined.mapInArrow(tile, "__key long, doc_id long, item_id long, item_words long, covered long, tiles long")
    return out.dropDuplicates(["__key", "item_id"]).withColumn("coverage", F.col("covered") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """The documents that reach the threshold for no item, with all their columns."""
    gone = contaminated(docs, benchmark, coverage, least).select(F.col("__key").alias("__gone"), F.col("doc_id").alias("__doc")).distinct()
    # by the id as well, so that one hash of two rows takes no innocent one
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == gone["__gone"]) & docs["doc_id"].cast("long").eqNullSafe(gone["__doc"])
    return docs.join(gone, same, "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("__key")
