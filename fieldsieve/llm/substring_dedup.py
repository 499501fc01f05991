"""Passages that repeat, by MinHash banding of paragraphs.

A paragraph is a line; one of more than `LONG` words is cut at content marks (see below), which
depend on nearby words only, so copies are cut alike. Paragraphs of equal words are one class.
Classes that share one of the bands (`ROWS` minimal five-word shingles each, as many bands as
`tuned` asks for) are compared, exact Jaccard similarity confirms, and components of classes are
clusters. A list of up to `SHORT` classes gives all its pairs. Members of longer lists meet their
centre, the one whose shingles are most widely held; those still in different components after
that are paired by an exact prefix filter on their full sets, so no link depends on the length of a list.

A verbatim passage need not fill a line. So the least of every `REACH` neighbouring windows of
`MARK` words is a class as well, wherever it stands: two texts that agree on MARK + REACH - 1
words or more always share one. Every occurrence of a cluster but its first goes. Touching ones,
and marks of one passage, form a run, which is extended word by word as far as it agrees with the
first occurrence (up to `CONTEXT` words on either side; the next mark is nearer than that). Runs
of fewer than `LEAST_WORDS` words stay.

Defined results
- null or empty text: no paragraph, no row. Lines under five words are not compared.
- null doc_id: its document is left as it is.
- repeated rows (one doc_id twice) count as one document: its units come together.
- ties: the first occurrence is that of the least doc_id, then of the least place.
- very long texts: they are cut into as many units as they need; work grows with their length.
- an empty table: no rows. Further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .bitmaps import bitmap, hits, xxhash64
from .common import cut, discard
from .components import components, stars
from .near_dedup import _confirm, _exploded, _ordered, _prefix_pairs
from .shingles import MULTIPLIER, SIZE, line_hashes, mixed, slices, windows

#: A mark covers so many words and is the least of so many.
MARK, REACH = 16, 32
#: Lines over this many words are cut, at one mark of `COARSE`.
LONG, COARSE = 120, np.uint64(3)
ROWS, RECALL = 2, 0.99
SHORT = 16
LEAST_WORDS = 24
#: Runs that are looked at for an extension, and how far it goes in one direction.
LEAST_SEED, CONTEXT = 8, 64
PASSAGE, PARAGRAPH = 0, 1
LEFT, RIGHT = 0, 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tuned(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """How many bands of so many rows let a pair at the threshold meet with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, (percent / 100) ** rows))))


def marks(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the least window in every run of REACH windows of each document; of all its windows, if they are fewer."""
    counts = np.maximum(np.diff(starts) - MARK + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    every = windows(hashes, MARK)
    first = np.cumsum(counts + REACH) - counts - REACH  # documents apart, so that none depends on a neighbouring one
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, word = place + np.repeat(first, counts), place + np.repeat(starts[:-1], counts)
    least = np.full(int((counts + REACH).sum()) + REACH, np.iinfo(np.uint64).max, np.uint64)
    least[at] = every[word] & ~np.uint64(255) | (at & 255).astype(np.uint64)  # the place decides among equal ones and is read back
    step = 1
    while step < REACH:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    here = at[place <= np.repeat(np.maximum(counts - REACH, 0), counts)]
    found = np.zeros(len(least), bool)
    found[here + ((least[here] & np.uint64(255)).astype(np.int64) - here) % 256] = True
    word = word[found[at]]
    return word, every[word]


def paragraphs(n: int, starts: np.ndarray, lines: np.ndarray, mark: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of each line, and of the parts of long lines."""
    words = np.diff(np.append(lines, n))
    begins = np.zeros(n, bool)
    begins[mark[mixed(hash_) % COARSE == 0]] = True
    begins &= np.repeat(words, words) > LONG
    begins[lines] = True
    begin = np.flatnonzero(begins)
    return np.searchsorted(starts, begin, side="right") - 1, begin, np.diff(np.append(begin, n))


def _classes(hashes: np.ndarray, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of all words of each paragraph, in their order; paragraphs are next to each other."""
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(begin, words).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(hashes + place * MULTIPLIER), begin)) if len(begin) else np.zeros(0, np.uint64)


def _bands(every: np.ndarray, begin: np.ndarray, words: np.ndarray, bands: int) -> np.ndarray:
    """The keys of each unit, a column for each band; every: the shingle at each word and one more."""
    bounds = np.stack([begin, begin + words - SIZE + 1], axis=1).ravel()
    out = np.empty((len(begin), bands), np.uint64)
    if not len(begin):
        return out
    for band in range(bands):
        key = np.full(len(begin), np.uint64(band))
        for row in range(ROWS):
            least = np.minimum.reduceat(mixed(every ^ np.uint64((band * ROWS + row) * 0x5851F42D4C957F2D & (2**64 - 1))), bounds)[::2]
            key = key * MULTIPLIER + least
        out[:, band] = mixed(key)
    return out


def _units(docs: DataFrame, bands: int) -> DataFrame:
    """(kind, doc_id, start, words, node, keys): every unit, start counted in words of its document, node its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts, lines = line_hashes(batch.column("text").to_pylist())
            word, hash_ = marks(hashes, starts)
            doc, begin, words = paragraphs(len(hashes), starts, lines, word, hash_)
            node, keep = _classes(hashes, begin, words), words >= SIZE
            doc, begin, words, node = doc[keep], begin[keep], words[keep], node[keep]
            every = np.append(windows(hashes), np.zeros(min(len(hashes), SIZE), np.uint64))
            flat = pa.array(_bands(every, begin, words, bands).ravel().view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * bands), flat)
            yield rows(batch, PARAGRAPH, doc, begin - starts[doc], words, node, keys)
            doc = np.searchsorted(starts, word, side="right") - 1
            yield rows(batch, PASSAGE, doc, word - starts[doc], np.full(len(word), MARK), mixed(hash_), pa.nulls(len(word), pa.list_(pa.int64())))

    def rows(batch: pa.RecordBatch, kind: int, doc: np.ndarray, start: np.ndarray, words: np.ndarray, node: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(doc))
        columns = [pa.array(np.full(len(doc), kind, np.int32)), ids, pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(node.view(np.int64)), keys]
        return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "start", "words", "node", "keys"])

    return docs.mapInArrow(run, "kind int, doc_id long, start int, words int, node long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, only: Broadcast) -> DataFrame:
    """(node, set): the packed shingles of wanted classes (node, doc_id, start); only: a bitmap of what is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts, lines = line_hashes(batch.column("text").to_pylist())
            doc, begin, words = paragraphs(len(hashes), starts, lines, *marks(hashes, starts))
            node, keep = _classes(hashes, begin, words).view(np.int64), words >= SIZE
            ids, place = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)[doc], begin - starts[doc]
            at = np.flatnonzero(keep & hits(only.value, xxhash64(node, ids, place)))
            every = windows(hashes)
            sets = [np.unique(every[begin[i] : begin[i] + words[i] - SIZE + 1]).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(ids[at]), pa.array(place[at]), pa.array(sets, pa.binary())], ["node", "doc_id", "start", "set"])

    found = docs.mapInArrow(run, "node long, doc_id long, start long, set binary")
    return found.join(wanted, ["node", "doc_id", "start"], "left_semi").select("node", "set").dropDuplicates(["node"])


def _held(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, wide) of the members of long lists that can be near to another.

    Of a node's shingles, as many must be held by others as a link needs. wide is about how many of
    them those that are like it hold as well.
    """
    every = _exploded(sets.join(long.select("node").distinct(), "node"))
    counts = every.groupBy("shingle").agg(F.count("*").alias("n"))
    wide = (F.sum("n") / F.max("n")).alias("wide")
    out = every.join(counts, "shingle").groupBy("node").agg(F.count("*").alias("size"), wide, F.count_if(F.col("n") > 1).alias("held"))
    return out.where(100 * F.col("held") >= percent * F.col("size")).drop("held")


def _apart_links(long: DataFrame, links: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links with the components of links and of those between members of long lists (key, node) that join what links leave apart; tried: pairs that were compared.

    A list's centre is the member that is likely to be near to most others, so few are left apart.
    """
    long = cut(long.join(_held(long, sets, percent), "node"), "long")
    usual = long.groupBy("key").agg(F.avg("size").alias("usual"))
    like = F.col("wide") / (F.col("size") + F.col("usual") - F.col("wide"))
    centre = long.join(usual, "key").groupBy("key").agg(F.max_by("node", F.struct(like, -F.col("node"))).alias("b"))
    first = cut(_ordered(long.join(centre, "key").select(F.col("node").alias("a"), "b")).distinct().join(tried, ["a", "b"], "left_anti"), "first")
    links = cut(links.union(_confirm(first, sets, percent)), "links")
    done = stars(links)
    links = done.select(F.col("b").alias("a"), F.col("a").alias("b"))  # what follows goes on from there
    now = long.join(done.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    apart = cut(now.join(many, "key").select("node", "size", "component").distinct(), "apart")
    if apart.isEmpty():
        return links
    more = cut(_ordered(_prefix_pairs(apart, sets, percent)).distinct().join(tried.union(first), ["a", "b"], "left_anti"), "more")
    return cut(links.union(_confirm(more, sets, percent)), "links")


def _near(docs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the paragraph classes that are near to others."""
    lines = units.where(F.col("kind") == PARAGRAPH)
    keys = lines.select("node", F.explode("keys").alias("key"))
    lists = cut(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last").select("key"), "lists")
    members = cut(keys.join(lists, "key", "left_semi").distinct(), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    long = cut(members.join(sizes.where(F.col("n") > SHORT).select("key"), "key"), "long")
    short = members.join(long.select("key").distinct(), "key", "left_anti")
    pairs = short.alias("x").join(short.alias("y"), "key").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = cut(_ordered(pairs).distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long.select("node")).distinct()
    wanted = lines.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "start")).alias("s"))
    wanted = cut(wanted.select("node", "s.doc_id", F.col("s.start").cast("long").alias("start")), "wanted")
    only = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.xxhash64("node", "doc_id", "start")))
    sets = cut(_sets(docs, wanted, only), "sets")
    links = cut(_confirm(pairs, sets, percent), "links")
    if not long.isEmpty():
        links = _apart_links(long.select("key", "node"), links, pairs, sets, percent)
    out = components(links)
    for done in (lists, members, long, pairs, wanted, sets):
        discard(done)
    return out


def _runs(pieces: DataFrame) -> DataFrame:
    """Pieces (doc_id, start, end, left, right, origin) that touch or overlap or are near marks of one passage, as one each.

    left and right say where the first and the last word's end stand in the first occurrence;
    origin and weight are those of the longest piece.
    """
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    shift = F.struct("left.doc_id", F.col("start") - F.col("left.at"))
    gap = F.when(F.lag(shift).over(by) == shift, REACH).otherwise(0)
    numbered = pieces.withColumn("new", (before.isNull() | (F.col("start") > before + gap)).cast("long")).withColumn("run", F.sum("new").over(by))
    order = F.struct("end", -F.col("start"))
    merged = numbered.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("left", F.struct("start", -F.col("end"))).alias("left"), F.max_by("right", order).alias("right"), F.max_by("origin", F.struct("weight", -F.col("start"))).alias("origin"), F.max("weight").alias("weight"))
    return merged.drop("run")


def _asked_for(places: DataFrame) -> np.ndarray:
    """A bitmap of places (doc_id, at, side), two bits for each."""
    keys = F.array(F.xxhash64("doc_id", "at", "side"), F.xxhash64("side", "at", "doc_id"))
    return bitmap(places.select(F.explode(keys).alias("key")), F.col("key"))


def _contexts(docs: DataFrame, only: Broadcast) -> DataFrame:
    """(doc_id, at, side, words): hashes of the words on that side of the places that the bitmap has, nearest first.

    Runs begin and end where units do, so no other places are looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts, lines = line_hashes(batch.column("text").to_pylist())
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            mark, hash_ = marks(hashes, starts)
            doc, begin, words = paragraphs(len(hashes), starts, lines, mark, hash_)
            doc, begin = np.append(doc, np.searchsorted(starts, mark, side="right") - 1), np.append(begin, mark)
            end = begin + np.append(words, np.full(len(mark), MARK))
            short = hashes.astype(np.uint32)
            for side, x in ((LEFT, begin), (RIGHT, end)):
                once = np.unique(x + doc, return_index=True)[1]  # a document's end is apart from the next one's first word
                d, x = doc[once], x[once]
                place, s = x - starts[d], np.full(len(d), side)
                asked = hits(only.value, xxhash64(ids[d], place, s)) & hits(only.value, xxhash64(s, place, ids[d]))
                d, x, place, s = d[asked], x[asked], place[asked], s[asked]
                a, b = (np.maximum(starts[d], x - CONTEXT), x) if side == LEFT else (x, np.minimum(starts[d + 1], x + CONTEXT))
                step = -1 if side == LEFT else 1
                near = [short[i:j][::step].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(place), pa.array(s), pa.array(near, pa.binary())], ["doc_id", "at", "side", "words"])

    return docs.mapInArrow(run, "doc_id long, at long, side long, words binary").dropDuplicates(["doc_id", "at", "side"])


def _extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs, each as far as it agrees with its first occurrence in another document."""
    side = lambda name, at, to: F.struct(F.lit(name).cast("long").alias("side"), F.col(at).cast("long").alias("at"), F.col(f"{to}.doc_id").alias("other"), F.col(f"{to}.at").cast("long").alias("there"))
    asked = runs.where(F.col("end") - F.col("start") >= LEAST_SEED).select("doc_id", F.col("start").alias("run"), F.explode(F.array(side(LEFT, "start", "left"), side(RIGHT, "end", "right"))).alias("x"))
    # left of a text's first word there is nothing to agree on
    asked = asked.select("doc_id", "run", "x.*").where((F.col("other") != F.col("doc_id")) & ((F.col("side") == RIGHT) | (F.col("at") > 0) & (F.col("there") > 0)))
    asked = cut(asked, "asked")
    places = asked.select("doc_id", "at", "side").union(asked.select("other", "there", "side")).distinct()
    only = docs.sparkSession.sparkContext.broadcast(_asked_for(places))
    contexts = _contexts(docs, only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n = min(len(x), len(y)) // 4
                differ = np.flatnonzero(np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n))
                more.append(int(differ[0]) if len(differ) else n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "run", "side")), pa.array(more, pa.int32())], ["doc_id", "run", "side", "more"])

    # both joins are by the columns that contexts are deduplicated by, so these are shuffled once
    here = asked.join(contexts.withColumnRenamed("words", "x"), ["doc_id", "at", "side"])
    there = contexts.select(F.col("doc_id").alias("other"), F.col("at").alias("there"), "side", F.col("words").alias("y"))
    both = here.join(there, ["other", "there", "side"]).select("doc_id", "run", "side", "x", "y").mapInArrow(run, "doc_id long, run int, side long, more int")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("more"))), F.lit(0)).cast("int")
    more = both.groupBy("doc_id", F.col("run").alias("start")).agg(part(LEFT).alias("l"), part(RIGHT).alias("r"))
    out = runs.join(more, ["doc_id", "start"], "left")
    left, right = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    moved = {"start": F.col("start") - left, "end": F.col("end") + right, "left": F.struct("left.doc_id", (F.col("left.at") - left).alias("at")), "right": F.struct("right.doc_id", (F.col("right.at") + right).alias("at"))}
    return out.select(*[moved.get(c, F.col(c)).alias(c) for c in runs.columns])


def _firsts(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_words): where the runs come first, those that overlap as one.

    A run whose two ends lie in one first document is there what lies between them; of a run that is
    put together from several documents it is the longest of its pieces.
    """
    whole = (F.col("left.doc_id") == F.col("right.doc_id")) & (F.col("right.at") > F.col("left.at"))
    pick = lambda a, b: F.when(whole, F.col(a)).otherwise(b)
    spans = found.select(pick("left.doc_id", F.col("origin.doc_id")).alias("doc_id"), pick("left.at", F.col("origin.at")).alias("start"), pick("right.at", F.col("origin.at") + F.col("weight")).alias("end")).distinct()
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before)).cast("long")
    runs = spans.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words"))


def repeated(docs: DataFrame, percent: int = 75, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, removed): each run of words that repeats.

    start counts words of the text from 0. removed is false at the first occurrence of what others repeat.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    units = cut(_units(docs, tuned(percent)), "units")
    near = _near(docs, units, percent)
    places = units.select("kind", "doc_id", "start", "words", "node")
    lines = places.where(F.col("kind") == PARAGRAPH).join(near, "node", "left").withColumn("node", F.coalesce("component", "node"))
    places = places.where(F.col("kind") == PASSAGE).drop("kind").unionByName(lines.drop("kind", "component"))
    many = cut(places.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "many")
    used = cut(places.join(many, "node"), "used")
    first = used.groupBy("node").agg(F.min(F.struct("doc_id", "start", "words")).alias("f"))
    again = used.join(first, "node").where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("start") != F.col("f.start")))
    at = lambda x: F.struct(F.col("f.doc_id"), x.alias("at"))
    again = again.select("doc_id", "start", (F.col("start") + F.col("words")).alias("end"), at(F.col("f.start")).alias("left"), at(F.col("f.start") + F.col("f.words")).alias("right"), at(F.col("f.start")).alias("origin"), F.col("words").alias("weight"))
    runs = cut(_runs(again), "runs")
    longer = _runs(_extended(docs, runs)).withColumn("n_words", F.col("end") - F.col("start"))
    found = cut(longer.where(F.col("n_words") >= least_words), "found")
    for done in (units, many, used, runs):
        discard(done)
    long = [F.col(c).cast("long").alias(c) for c in ("start", "n_words")]
    return found.select("doc_id", *long, F.col("origin.doc_id").alias("first_doc_id"), F.lit(True).alias("removed")).union(_firsts(found).select("doc_id", *long, F.col("doc_id").alias("first_doc_id"), F.lit(False)))


def without_repeats(docs: DataFrame, percent: int = 75, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with every repeated run cut from its text, but for the first occurrence; n_chars, where it is a column, follows."""
    cuts_of, key = (f"{n}_{uuid.uuid4().hex}" for n in ("cuts", "doc"))  # names that no column has
    gone = repeated(docs, percent, least_words).where("removed").groupBy("doc_id")
    gone = gone.agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias(cuts_of)).withColumnRenamed("doc_id", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (text, cuts) in enumerate(zip(texts, batch.column(cuts_of).to_pylist(), strict=True)):
                if text and cuts:
                    ends = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    out, at = [], 0
                    for x in cuts:
                        a, b = x["start"], min(x["start"] + x["n_words"], len(ends)) - 1
                        if a <= b and ends[a][0] >= at:
                            out.append(text[at : ends[a][0]])
                            at = ends[b][1]
                    texts[i] = "".join([*out, text[at:]]).strip()
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n not in (cuts_of, key)]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n not in (cuts_of, key)])

    out = docs.join(gone, docs["doc_id"] == gone[key], "left").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
