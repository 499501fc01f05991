"""Near duplicates by bottom-k sketches.

One hash function orders all shingles; the k least of a text are its sketch. Inverted lists
of sketch values give the overlaps of sketches, an estimate on the union sketch drops pairs
that are far apart, and the full sets confirm the rest.

- Texts with equal sets are one class; only its representative (least doc_id) is compared.
- A list of up to `SHORT` representatives gives all its pairs. In a longer list every member
  is compared with one centre. Members of a long list that are in different components after
  that are paired by an exact prefix filter on their full sets. So no link depends on a cap.
- A pair at the similarity bound is missed only if its estimate falls below half the bound,
  about once in ten million such pairs.

Defined results
- null or empty text, or white space only: no shingles, linked with nothing, its own component.
- fewer than five words: one shingle of all of them.
- null doc_id: takes the component of its class if another row of it has a doc_id, else null;
  kept if null. Rows with one doc_id are one document, so they are linked with each other's.
- repeated rows: each gets its row. Further columns don't matter here, whatever their names.
- ties: the least doc_id stands for its class and its component. An empty table: no rows.
- very long texts: all of their shingles count; a set is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .bitmaps import bitmap, hits
from .common import cut
from .components import components, stars
from .shingles import common, shingle_sets, slices

K = 48
SHORT = 16
#: Of the union sketch, the share that a pair needs in common to be looked at; half the bound.
LEAST_SHARE = 0.375


def _signatures(docs: DataFrame, full: bool, only: Broadcast | None = None) -> DataFrame:
    """(doc_id, k1, k2, n, sketch or the full packed set) of each document; only: a bitmap that the hash of doc_id must hit."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(only.value, batch.column("h").to_numpy(zero_copy_only=False)))) if only else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(passed(batches)):
            k1, k2, n, values = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                k1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                k2.append(int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                n.append(len(s))
                values.append(s.tobytes() if full else s[:K].view(np.int64))
            last = pa.array(values, pa.binary() if full else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), last], ["doc_id", "k1", "k2", "n", "v"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, f"doc_id long, k1 long, k2 long, n long, v {'binary' if full else 'array<long>'}")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = p.as_py(), q.as_py()
                both = common(p, q)
                keep.append(100 * both >= percent * (len(p) // 8 + len(q) // 8 - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _short_pairs(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of the short lists that may be near, by the union sketch; entries: (value, node, size, rank)."""
    lists = entries.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("node", "size", "rank"))).alias("l"))
    pair = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["size"].alias("na"), y["size"].alias("nb"), (x["rank"] * 256 + y["rank"]).alias("r"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, SHORT), lambda y: pair(x, y))))
    rows = lists.select(F.explode(pairs).alias("p")).select("p.*").where((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")))
    met = rows.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sort_array(F.collect_list("r")).alias("r"))
    size = F.size("r")
    of_union = F.least(F.lit(K), F.least("na", F.lit(K)) + F.least("nb", F.lit(K)) - size)
    # the i-th shared value stands at place (rank in a) + (rank in b) - i of the union
    inside = F.size(F.filter("r", lambda x, i: F.floor(x / 256) + x % 256 - i < K))
    for c in ("a", "b"):
        met = met.join(hot.select(F.col("node").alias(c), F.col("hot").alias(f"h{c}")), c, "left")
    of_long = F.coalesce(F.least("ha", "hb"), F.lit(0))
    of_long = F.when(F.col("ha").isNull() | F.col("hb").isNull(), 0).otherwise(of_long)
    shared = F.when(of_long == 0, inside).otherwise(size + of_long)
    return met.where(shared >= LEAST_SHARE * of_union).select("a", "b")


def _held(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, held): how many of a node's shingles another node of `hot` has too; without nodes that it rules out.

    No pair shares more than the lesser `held`. So a copy with many edits of its own is out
    before it is compared with anything.
    """

    every = _exploded(sets.join(hot.select("node"), "node"))
    alone = every.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    out = hot.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("held"))
    return out.where(100 * F.col("held") >= percent * F.col("size"))


def _long_links(long: DataFrame, held: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links with the components of links and of those between members of long lists that join what links leave apart; the former as stars."""
    long = cut(long.select("value", "node").join(held, "node"), "long")
    best = F.max_by("node", F.struct(F.col("held") / F.col("size"), -F.col("node")))  # the fewest shingles of its own
    centre = long.groupBy("value").agg(best.alias("b"))
    tried = cut(_ordered(long.join(centre, "value").select(F.col("node").alias("a"), "b")).distinct(), "tried")
    links = cut(links.union(_confirm(tried, sets, percent)), "links")
    done = stars(links)
    links = done.select(F.col("b").alias("a"), F.col("a").alias("b"))  # what follows goes on from there
    now = long.join(done.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = now.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    apart = cut(now.join(many, "value").select("node", "size", "component").distinct(), "apart")
    if apart.isEmpty():
        return links
    more = cut(_ordered(_prefix_pairs(apart, sets, percent)).distinct().join(tried, ["a", "b"], "left_anti"), "more")
    return cut(links.union(_confirm(more, sets, percent)), "links")


def _exploded(sets: DataFrame) -> DataFrame:
    """(node, shingle) of packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("set").to_pylist()
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) // 8 for x in packed])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.frombuffer(b"".join(packed), dtype=np.int64))], ["node", "shingle"])

    return sets.select("node", "set").mapInArrow(run, "node long, shingle long")


def _prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be near, by an exact prefix filter on the full sets.

    Shingles are ordered by how many of the nodes hold them, the rarest first. Of two sets at
    the bound, the rarest shingle in common stands within the first quarter of the larger set
    and early enough in the smaller one that what follows it in either can still make the
    overlap. So copies of one text with edits of their own do not even meet.
    """
    every = _exploded(sets.join(apart.select("node"), "node"))
    held = every.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = every.join(held, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    ranked = ranked.join(apart, "node")
    first = F.slice("s", 1, F.col("size").cast("int") - F.ceil(F.col("size") * percent / 100).cast("int") + 1)
    rows = ranked.select("node", "size", "component", F.posexplode(first).alias("at", "x")).where("x.n > 1")
    rows = cut(rows.select("node", "size", "component", "at", F.col("x.shingle").alias("shingle")), "prefixes")
    one = rows.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "component", "at")])
    two = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "component", "at")])
    follow = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    near = (100 + percent) * follow >= percent * (F.col("size_a") + F.col("size_b"))
    met = one.join(two, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & near)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def linked(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of docs."""
    signed = cut(_signatures(docs, False), "sketches")
    nodes = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.min_by("v", "doc_id").alias("v"))
    nodes = cut(nodes.where("node is not null"), "nodes")
    entries = nodes.select("node", F.col("n").alias("size"), F.posexplode("v").alias("rank", "value"))
    lists = entries.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    entries = cut(entries.join(lists, "value"), "entries")
    short, long = entries.where(F.col("members") <= SHORT), entries.where(F.col("members") > SHORT)
    hot = long.groupBy("node").agg(F.count("*").alias("hot"), F.first("size").alias("size"))
    close = cut(_short_pairs(short, hot), "close")
    # only those with this many values in long lists can be near to another through long lists alone
    hot = cut(hot.where(F.col("hot") >= LEAST_SHARE * F.least("size", F.lit(K))), "hot")

    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).union(hot.select("node")).distinct()
    wanted = cut(wanted.join(nodes.select("node", "k1", "k2"), "node"), "wanted")
    # a filter of fixed size keeps most other texts from being looked at; the join is exact
    only = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.xxhash64("node")))
    full = _signatures(docs, True, only).select(F.col("doc_id").alias("node"), "k1", "k2", F.col("v").alias("set"))
    sets = cut(full.join(wanted, ["node", "k1", "k2"], "left_semi").dropDuplicates(["node", "k1", "k2"]).select("node", "set"), "sets")

    links = cut(_confirm(close, sets, percent), "links")
    if not hot.isEmpty():
        links = _long_links(long, cut(_held(hot, sets, percent), "held"), links, sets, percent)
    found = components(links)
    classes = nodes.join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    out = signed.drop("v").join(classes, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, the one with the least doc_id, with all its columns; one row of repeated rows.

    Of rows with one doc_id and different texts, the one whose text has the least hash stays.
    """
    gone = linked(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__many"))
    repeated = cut(repeated, "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == repeated["__many"], "left_anti")
    same = left.join(repeated, left["doc_id"] == repeated["__many"], "left_semi")
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    one = same.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64("text"), "text")).alias("__row"))
    return once.unionByName(one.select("__row.*"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.doc_id = n.doc_id
"""
