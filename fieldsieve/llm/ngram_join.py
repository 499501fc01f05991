"""A self-join of documents by the Jaccard similarity of their word n-grams, with rarest-first prefix filtering.

All shingles stand in one order: by how many classes of equal sets hold them, the rarest first.
Two sets at the bound share a shingle among the first n - ceil(bound * n) + 1 of each, their
prefixes, so documents meet on prefix shingles only. A pair that meets must pass the filters
for length, position and suffix; what is left is verified once, on the full sets.

- One pass finds the classes and the shingles that are very frequent, at most `HOT_MOST` of them.
  These end the order, so documents that are not made of them never send them.
- The next pass sends the other shingles in packed sorted blocks, one for each range of the order's
  hashes. A range is counted in one task, and its size does not grow with the corpus. Shingles of
  one class come first in every prefix and are dropped there.
- A shingle that up to `SHORT` prefixes hold gives its pairs. In a longer list each member is
  compared with one centre, and members that are in different components after that are paired
  by their prefixes. No link between different texts depends on a cap.

Defined results
- null or empty text, or white space only: no shingles, linked with nothing, its own component.
- fewer than five words: one shingle of all of them.
- null doc_id: takes the component of its class if another row of it has a doc_id, else null.
  Rows with one doc_id are one document: it is in the component of each of its texts' links.
- repeated rows: each gets its row. Further columns don't matter here, whatever their names.
- ties: the least doc_id names a component. An empty table: no rows. Very long texts: whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .bitmaps import bitmap
from .common import cut
from .components import components
from .near_dedup import OP7_SQL, SHORT, _confirm, _held, _long_links, _ordered, _signatures
from .shingles import MULTIPLIER, shingle_sets, slices

#: Shingles that a task counts or sends at once.
CHUNK = 1 << 20
#: Shingles of a range.
RANGE = 1 << 21
#: A very frequent shingle is held by this many classes at least, and there are at most HOT_MOST of them.
HOT_LEAST, HOT_MOST = 4096, 1 << 18
#: A shingle that a chunk has fewer times is not counted there as very frequent.
LOCAL_LEAST = 16
#: Of a place in the order, the bits for the shingle; above them is how many hold it.
FP_BITS, TOP = 43, (1 << 20) - 1
#: Parts of the hash range in which the suffix filter counts shingles.
PARTS = 64


def _key_of(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as near_dedup has them."""
    return int(np.bitwise_xor.reduce(s).view(np.int64)), int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def _one(k1: int, k2: int) -> int:
    """A key of 64 bits for a class; like the shingles' own hashes it is taken to tell all apart."""
    return (k1 ^ k2 * int(MULTIPLIER)) % (1 << 64) - (1 << 63)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """((doc_id, k1, k2, n) of each row, the sets of new classes) for so many rows as have about `chunk` shingles."""
    rows, sets, seen, held = [], [], set(), 0
    for batch in slices(batches):
        for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True):
            k = _key_of(s) if len(s) else (0, 0)
            rows.append((doc, *k, len(s)))
            if len(s) and k not in seen:
                seen.add(k)
                sets.append(s)
                held += len(s)
        if held >= chunk:
            yield rows, sets
            rows, sets, seen, held = [], [], set(), 0
    if rows:
        yield rows, sets


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, key) of each row; and, with n -1, (count, shingle in k1) of the shingles that are frequent in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _chunks(batches, CHUNK):
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= LOCAL_LEAST
            columns = [list(c) for c in zip(*[(*r, _one(*r[1:3])) for r in rows], strict=True)]
            more = [counts[often].tolist(), values[often].view(np.int64).tolist(), *([x] * int(often.sum()) for x in (0, -1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.int64()) for a, b in zip(columns, more, strict=True)], ["doc_id", "k1", "k2", "n", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, key long")


def _packed(*columns: np.ndarray) -> list[bytes]:
    """Columns of longs with small or rising values, by byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    planes, at, out = pa.decompress(data, 8 * sum(sizes), codec="zstd", asbytes=True), 0, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, 8 * n, at).reshape(8, n).T).reshape(-1).view(np.uint64))
        at += 8 * n
    return out


def _ceil(percent: int, n):
    """The least overlap of a set of n with another at the bound."""
    return -(-percent * n // 100)


def _sent(docs: DataFrame, hot: np.ndarray, bits: int, ranges: int, percent: int) -> DataFrame:
    """What the second pass sends: (range, key, place, n, m, block).

    With a block: m shingles of n classes, packed, of a range. Without: of one class a very frequent
    shingle of its prefix (place), or how many it has (-place).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"range": pa.int32(), "key": pa.int64(), "place": pa.int64(), "n": pa.int64(), "m": pa.int64(), "block": pa.binary()}
        for _, sets in _chunks(batches, CHUNK):
            if not sets:
                continue
            keys = [_one(*_key_of(s)) for s in sets]
            out: list[tuple] = []
            cold = []
            for k, s in zip(keys, sets, strict=True):
                at = np.searchsorted(hot, s)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                h = int(is_hot.sum())
                cold.append(s[~is_hot])
                if h:
                    to = k % ranges
                    out.append((to, k, -h, None, None, None))
                    reach = len(s) - _ceil(percent, len(s)) + 1 - (len(s) - h)
                    places = np.sort(s[is_hot] >> np.uint64(64 - bits)).astype(np.int64) | (TOP << FP_BITS)
                    out += [(to, k, p, None, None, None) for p in places[: max(0, reach)].tolist()]
            ids = np.array(keys, np.int64).view(np.uint64)
            owner = np.repeat(np.arange(len(cold)), [len(s) for s in cold])
            prints = np.concatenate(cold) >> np.uint64(64 - bits)
            order = np.argsort(prints, kind="stable")
            prints, owner = prints[order], owner[order]
            edges = np.searchsorted(prints, np.array([-(-(r << bits) // ranges) for r in range(ranges)], np.uint64))
            for r, (a, b) in enumerate(zip(edges, [*edges[1:], len(prints)], strict=True)):
                if a < b:
                    used, index = np.unique(owner[a:b], return_inverse=True)
                    steps = np.diff(prints[a:b], prepend=np.uint64(0))
                    out.append((r, None, None, len(used), int(b - a), _packed(steps, index.astype(np.uint64), ids[used])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.values(), strict=True)], list(kind))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "range int, key long, place long, n long, m long, block binary")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Of rows that lie in runs of equal values, where each row's run begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _held_by(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How often each value occurs, in an order that sorts them."""
    starts = np.flatnonzero(_starts(values[order]) == np.arange(len(order)))
    sizes = np.diff(np.append(starts, len(order)))
    return np.repeat(sizes, sizes)


def _counted(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """(key, place) of the shingles of a range that several classes hold."""
    parts = []
    for n, m, data in blocks:
        steps, index, ids = _unpacked(data, [m, m, n])
        prints = np.cumsum(steps)
        order = np.lexsort((index, prints))
        prints, index = prints[order], index[order]
        # which of a class's shingles of one print it is; there is more than one only by chance
        which = (np.arange(m) - _starts(prints, index)).astype(np.int32)
        parts.append((prints, ids[index], which))
    prints, keys, which = map(np.concatenate, zip(*parts, strict=True))
    del parts
    order = np.argsort(prints, kind="stable")
    order = order[_held_by(prints, order) > 1]
    prints, keys, which = prints[order], keys[order], which[order]
    order = np.lexsort((which, keys, prints))
    prints, keys, which = prints[order], keys[order], which[order]
    same = np.zeros(len(prints), bool)  # several tasks may have met one class
    same[1:] = (prints[1:] == prints[:-1]) & (keys[1:] == keys[:-1]) & (which[1:] == which[:-1])
    prints, keys = prints[~same], keys[~same]
    held = _held_by(prints, np.arange(len(prints)))
    place = (np.minimum(held, TOP - 1) << FP_BITS) | prints.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[held > 1].view(np.int64)) for x in (keys, place)], ["key", "place"])


def _repeated(sent: DataFrame, parts: int) -> DataFrame:
    """(key, place) of all shingles that several classes hold, and what `_sent` gives without a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            alone = batch.filter(pc.is_null(batch.column("block")))
            if alone.num_rows:
                yield alone.select(["key", "place"])
            for r, n, m, data in zip(*[batch.column(c).to_pylist() for c in ("range", "n", "m", "block")], strict=True):
                if data is None:
                    continue
                if r != now and blocks:
                    yield _counted(blocks)
                    blocks = []
                now = r
                blocks.append((n, m, data))
        if blocks:
            yield _counted(blocks)

    return sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, "key long, place long")


def _prefixes(repeated: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(value, node, size, rank) of the shingles in prefixes that other classes hold too."""
    cold = (F.col("place") >= 0) & (F.col("place") < TOP << FP_BITS)
    # a class's own shingles; what is hot comes from each task that met the class, so it is a set
    lists = repeated.groupBy("key").agg(F.sort_array(F.collect_list(F.when(cold, F.col("place")))).alias("cold"), F.collect_set(F.when(F.col("place") >= TOP << FP_BITS, F.col("place"))).alias("last"), F.coalesce(-F.min(F.when(F.col("place") < 0, F.col("place"))), F.lit(0)).alias("hot"))
    rows = nodes.join(lists.withColumn("s", F.concat("cold", F.sort_array("last"))), "key")
    alone = F.col("n") - F.col("hot") - F.size("cold")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    rows = rows.withColumn("alone", alone).withColumn("reach", reach.cast("int")).where("reach > 0")
    rows = rows.select("node", F.col("n").alias("size"), "alone", F.posexplode(F.slice("s", F.lit(1), F.col("reach"))).alias("i", "value"))
    return rows.select("value", "node", "size", (F.col("alone") + F.col("i")).alias("rank"))


def _near(na: Column, ra: Column, nb: Column, rb: Column, percent: int) -> Column:
    """The length and positional filters for two sets whose first common shingle stands at ra and rb: what follows must be enough."""
    length = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return length & ((100 + percent) * F.least(na - ra, nb - rb) >= percent * (na + nb))


def _pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet in a short list and pass the length and positional filters."""
    lists = short.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("node", "size", "rank"))).alias("l"))  # SHORT at most
    each = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, SHORT), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = lists.select(F.explode(each).alias("p")).select("p.x", "p.y")
    rows = rows.where(_near(F.col("x.size"), F.col("x.rank"), F.col("y.size"), F.col("y.rank"), percent))
    return rows.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _parts(sets: DataFrame) -> DataFrame:
    """(node, size, parts): how many shingles of a set lie in each part of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
            counts = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=PARTS).tolist() for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in got], pa.int64()), pa.array(counts, pa.list_(pa.int32()))], ["node", "size", "parts"])

    return sets.select("node", "set").mapInArrow(run, "node long, size long, parts array<int>")


def _suffix(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that can reach the bound if each part of the hash range gives all it can."""
    parts = _parts(sets)
    for c in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("parts").alias(f"p{c}")), c)
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of docs; documents link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    first = cut(_classes(docs), "classes")
    signed = first.where("n >= 0")
    nodes = cut(signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.min("key").alias("key")).where("node is not null"), "nodes")
    total = signed.agg(F.sum("n")).first()[0] or 0
    bits = min(FP_BITS, max(20, int(total).bit_length() + 6))
    ranges = max(1, total // RANGE)
    often = first.where("n = -1").groupBy("k1").agg(F.sum("doc_id").alias("held")).where(F.col("held") >= max(HOT_LEAST, total // HOT_MOST))
    hot = np.sort(often.select("k1").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    repeated = _repeated(_sent(docs, hot, bits, ranges, percent), int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = cut(_prefixes(repeated, nodes, percent), "prefixes")
    lists = entries.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    entries = cut(entries.join(lists, "value"), "entries")
    short, long = entries.where(F.col("members") <= SHORT), entries.where(F.col("members") > SHORT)
    close = cut(_pairs(short, percent), "close")
    in_long = cut(long.select("node", "size").distinct(), "long")

    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).union(in_long.select("node")).distinct()
    wanted = cut(wanted.join(nodes, "node"), "wanted")
    only = spark.sparkContext.broadcast(bitmap(wanted, F.xxhash64("node")))
    full = _signatures(docs, True, only).select(F.col("doc_id").alias("node"), "k1", "k2", F.col("v").alias("set"))
    sets = cut(full.join(wanted, ["node", "k1", "k2"], "left_semi").dropDuplicates(["node", "k1", "k2"]).select("node", "set"), "sets")

    links = cut(_confirm(cut(_ordered(_suffix(close, sets, percent)), "filtered"), sets, percent), "links")
    if not in_long.isEmpty():
        links = _long_links(long, cut(_held(in_long, sets, percent), "held"), links, sets, percent)
    found = components(links)
    classes = nodes.join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(classes, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The sets and components are those of near_dedup, the bound is 80 and no row goes.
OP11_SQL = OP7_SQL.replace("100 * c >= 75 *", "100 * c >= 80 *").replace(", n.doc_id = m.component_id AS kept", "")
