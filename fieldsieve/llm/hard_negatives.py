"""Hard negatives for contrastive training, found with vantage-point trees over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2), M being the greatest norm; an anchor q is
stretched to norm M and gets 0. Then |q - x|^2 = 2 M^2 - 2 q.x, so the highest inner product is the
nearest point, a window of scores is an annulus of distances, and the triangle inequality prunes. All scores that decide anything
are integers; distances only rule out what is far outside, with a margin.

- A vantage-point tree fitted on at most `SAMPLE` rows sends every row to one of its leaves. A leaf's
  rows are dealt to blocks of about `BLOCK` rows by a hash, so copies of one vector fill many blocks.
  Each block holds a tree of its own; it is one row of a written table.
- Anchors travel in packs. A pack goes to those leaves that can hold a row of its annuli, and a task
  searches one pack in one block, nearest first, until each window has its rows or the annulus ends.
- First the anchors' own leaves give each a bound for its positives, then the other leaves that can
  beat it are searched, then all windows of an anchor together. The best k of all blocks are chosen
  by a window with a limit before the shuffle. Every row is indexed and found: results are exact.

Defined results
- a null vec_id, label or vector, or a null, NaN or infinite component: the row takes no part.
- rows with one vec_id are one row, the least by label, then vector. Further columns don't matter.
- vectors of unlike length: the shorter one counts as ending in zeros. An empty one has score 0 with all.
- ties: the smaller vec_id first. An anchor without positives, or a positive without negatives: no row.
- an empty table: no rows. Components beyond 2^20 in size after scaling: an error, scores would not be exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Rows that the routing tree is fitted on, at most; fewer if vectors are long.
SAMPLE, SAMPLE_VALUES = 4096, 1 << 22
#: Rows of a block, rows of a leaf of a block's tree, anchors of a pack.
BLOCK, LEAF, PACK = 4096, 96, 128
#: Anchors, or so, that are searched for in a block at once.
PART = 8192
#: What a component may be at most, so that sums of products are exact in doubles.
MOST = 1 << 20
#: Distances are computed in doubles; a bound is taken to be this much weaker.
MARGIN = 1e-6


@dataclass
class Tree:
    """Nodes of a vantage-point tree over the rows of `order`. vantage: -1 at a leaf, whose rows are order[lo:hi].

    An inner node has a near child and a far child; near and far hold the least and greatest
    distance of their rows from the vantage point.
    """

    order: np.ndarray
    vantage: np.ndarray
    spans: np.ndarray
    children: np.ndarray
    near: np.ndarray
    far: np.ndarray


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with sqrt(most - |x|^2) as one more component; most: the greatest squared norm."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], axis=1)


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A tree over points: the vantage point of a node is the row farthest from its first row, the split is the median."""
    order = np.arange(len(points))
    vantage, spans, children, near, far = [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        at = len(vantage)
        vantage.append(-1)
        spans.append((lo, hi))
        children.append((-1, -1))
        near.append((0.0, 0.0))
        far.append((0.0, 0.0))
        return at

    todo = [node(0, len(points))]
    while todo:
        at = todo.pop()
        lo, hi = spans[at]
        if hi - lo <= leaf:
            continue
        rows = order[lo:hi]
        chosen = rows[int(np.argmax(((points[rows] - points[rows[0]]) ** 2).sum(1)))]
        away = np.sqrt(((points[rows] - points[chosen]) ** 2).sum(1))
        if away.max() == 0:  # copies of one vector: no split tells them apart
            continue
        by = np.argsort(away, kind="stable")
        order[lo:hi], away = rows[by], away[by]
        mid = (hi - lo) // 2
        vantage[at] = int(chosen)
        children[at] = (node(lo, lo + mid), node(lo + mid, hi))
        near[at], far[at] = (float(away[0]), float(away[mid - 1])), (float(away[mid]), float(away[-1]))
        todo += children[at]
    pairs = lambda x, kind: np.array(x, kind).reshape(-1, 2)
    return Tree(order, np.array(vantage, np.int64), pairs(spans, np.int64), pairs(children, np.int64), pairs(near, float), pairs(far, float))


class Router:
    """The tree that deals rows out to leaves, fitted on a sample; leaves are its leaf nodes, numbered as they come."""

    def __init__(self, sample: np.ndarray, most: float, leaf: int):
        self.most = most
        points = augmented(sample, most)
        tree = grow(points, leaf)
        self.tree, self.points = tree, points[np.maximum(tree.vantage, 0)] if len(points) else points
        self.radius = tree.near[:, 1]
        self.numbers = np.cumsum(tree.vantage < 0) - 1
        #: for each leaf the nodes above it and whether it is on the near side
        self.paths: list[list[tuple[int, int]]] = [[] for _ in range(int((tree.vantage < 0).sum()))]
        stack: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        while stack:
            at, path = stack.pop()
            if tree.vantage[at] < 0:
                self.paths[self.numbers[at]] = path
            else:
                stack += [(int(tree.children[at][s]), [*path, (at, s)]) for s in (0, 1)]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        points, at = augmented(x, self.most), np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.tree.vantage[at] >= 0)
            if not len(inner):
                return self.numbers[at]
            away = np.sqrt(((points[inner] - self.points[at[inner]]) ** 2).sum(1))
            at[inner] = self.tree.children[at[inner], (away > self.radius[at[inner]]).astype(int)]

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance from each row of q (anchors) to what can lie in each leaf."""
        points = np.concatenate([q * stretch((q * q).sum(1), self.most)[:, None], np.zeros((len(q), 1))], axis=1)
        away = np.sqrt(((points[:, None, :] - self.points[None, :, :]) ** 2).sum(2)) if len(self.points) else np.zeros((len(q), 1))
        low, high = np.zeros((len(q), len(self.paths))), np.full((len(q), len(self.paths)), np.inf)
        for leaf, path in enumerate(self.paths):
            for at, side in path:
                if side == 0:
                    low[:, leaf] = np.maximum(low[:, leaf], away[:, at] - self.radius[at])
                    high[:, leaf] = np.minimum(high[:, leaf], away[:, at] + self.radius[at])
                else:
                    low[:, leaf] = np.maximum(low[:, leaf], self.radius[at] - away[:, at])
        return low, high


def stretch(q2, most: float):
    """What an anchor of squared norm q2 is multiplied by."""
    q2 = np.asarray(q2, float)
    return np.where(q2 > 0, np.sqrt(most / np.where(q2 > 0, q2, 1.0)), 1.0)


def annulus(q2: float, most: float, low: float, high: float) -> tuple[float, float]:
    """The distances at which scores from low to high lie, a little wider."""
    c = float(stretch(np.float64(q2), most))
    inner, outer = (np.sqrt(max(0.0, c * c * q2 + most - 2 * c * s)) if np.isfinite(s) else (0.0 if s > 0 else np.inf) for s in (high, low))
    return inner * (1 - MARGIN) - MARGIN, outer * (1 + MARGIN) + MARGIN


class Block:
    """Some rows with their tree. Vectors lie in the tree's order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: float, tree: Tree | None = None):
        if tree is None:
            tree = grow(augmented(x, most), LEAF)
            ids, labels, x = ids[tree.order], labels[tree.order], x[tree.order]
            tree.vantage = np.where(tree.vantage >= 0, np.argsort(tree.order)[np.maximum(tree.vantage, 0)], -1)
        self.ids, self.labels, self.x, self.most, self.tree = ids, labels, x, most, tree
        inner = np.maximum(tree.vantage, 0)
        self.points = augmented(x[inner], most) if len(x) else np.zeros((0, 1))

    def walk(self, q: np.ndarray, low: float, high: float, wanted) -> Iterator[tuple[int, int, int]]:
        """(score, vec_id, row) of the rows with low <= score <= high and wanted(labels), nearest first; equal scores by vec_id.

        The caller stops when it has enough, and what is farther is not looked at.
        """
        tree, q2 = self.tree, float(q @ q)
        nearest, farthest = annulus(q2, self.most, low, high)
        c = float(stretch(np.float64(q2), self.most))
        away = np.sqrt(((self.points - np.append(c * q, 0.0)) ** 2).sum(1))
        # (-score, is a row, vec_id, node or row): a node goes before a row that is as near
        heap: list[tuple[float, bool, int, int]] = [(-np.inf, False, 0, 0)]
        while heap:
            key, is_row, vec_id, at = heapq.heappop(heap)
            if is_row:
                yield int(-key), vec_id, at
            elif tree.vantage[at] < 0:
                a, b = tree.spans[at]
                scores = self.x[a:b] @ q
                for i in np.flatnonzero((scores >= low) & (scores <= high) & wanted(self.labels[a:b])).tolist():
                    heapq.heappush(heap, (-float(scores[i]), True, int(self.ids[a + i]), int(a + i)))
            else:
                for child, (least, most) in zip(tree.children[at].tolist(), (tree.near[at], tree.far[at]), strict=True):
                    close = max(0.0, least - away[at], away[at] - most) * (1 - MARGIN) - MARGIN
                    if close <= farthest and away[at] + most >= nearest:
                        heapq.heappush(heap, (-min((c * c * q2 + self.most - close * abs(close)) / (2 * c), high), False, 0, child))

    def top(self, q: np.ndarray, label: int, own: int, k: int, low: float) -> list[tuple[int, int]]:
        """The first k (score, vec_id) of the label with a score of low at least, without the row `own`."""
        out = []
        for score, vec_id, _ in self.walk(q, low, np.inf, lambda labels: labels == label):
            if vec_id != own:
                out.append((score, vec_id))
                if len(out) == k:
                    break
        return out

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score) the first k rows of other labels; one walk for all windows."""
        out: list[list[tuple[int, int]]] = [[] for _ in windows]
        live = [i for i, (a, b) in enumerate(windows) if a <= b]
        if live:
            low, high = min(windows[i][0] for i in live), max(windows[i][1] for i in live)
            for score, vec_id, _ in self.walk(q, low, high, lambda labels: labels != label):
                live = [i for i in live if len(out[i]) < k and windows[i][0] <= score]
                if not live:
                    break
                for i in live:
                    if score <= windows[i][1]:
                        out[i].append((score, vec_id))
        return out


def window_of(score: Column | int, low_percent: int):
    """(least, greatest) integer score of a negative for a positive's score."""
    return -((-low_percent * score) // 100), score


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as floor(scale * x), one row for each vec_id."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) * scale < MOST)
    v = F.when(fits, F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact scores")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    lists = column.to_pylist() if column.null_count else None
    counts = np.diff(column.offsets.to_numpy()) if lists is None else np.array([len(x or ()) for x in lists])
    flat = column.flatten().to_numpy(zero_copy_only=False) if lists is None else np.concatenate([np.zeros(0), *[np.array(x) for x in lists if x]])
    if (counts == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(counts), width))
    out[np.arange(width) < counts[:, None]] = flat
    return out


def _blocks(rows: DataFrame, router, pieces: dict[int, int], width: int, most: float) -> DataFrame:
    """(leaf, ids, labels, x, and the tree) of each block."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = router.value.route(_matrix(batch.column("v"), width))
            of = np.array([pieces[i] for i in leaf.tolist()], np.uint64)
            piece = (batch.column("h").to_numpy().view(np.uint64) % of).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "v")], pa.array(leaf, pa.int32()), pa.array(piece, pa.int32())], ["vec_id", "label", "v", "leaf", "piece"])

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = Block(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"].combine_chunks(), width), most)
        t = block.tree
        parts = [block.ids, block.labels.astype(np.int32), block.x.astype(np.int32), t.vantage, t.spans, t.children, t.near, t.far]
        return pa.table({"leaf": table["leaf"].slice(0, 1), "piece": table["piece"].slice(0, 1), "parts": pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))})

    placed = rows.select("vec_id", "label", "v", F.xxhash64("vec_id").alias("h")).mapInArrow(place, "vec_id long, label int, v array<int>, leaf int, piece int")
    return placed.groupBy("leaf", "piece").applyInArrow(build, "leaf int, piece int, parts array<binary>")


def _block(parts: list[bytes], width: int, most: float) -> Block:
    ids, labels, x, vantage, spans, children, near, far = parts
    pairs = lambda data, kind: np.frombuffer(data, kind).reshape(-1, 2)
    tree = Tree(np.zeros(0, np.int64), np.frombuffer(vantage, np.int64), pairs(spans, np.int64), pairs(children, np.int64), pairs(near, float), pairs(far, float))
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int32), np.frombuffer(x, np.int32).reshape(-1, width).astype(float), most, tree)


def _visits(anchors: DataFrame, router, pieces: dict[int, int], parts: int, width: int, to: str, low_percent: int) -> DataFrame:
    """(leaf, piece, part, ids, labels, x, low, windows): packs of the anchors that must be searched for in a block.

    anchors: (vec_id, label, v, low, windows): the least score that matters, null if any does, or the
    scores of the positives. to: "own", "others" or "all", the leaves that an anchor may go to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                batch = whole.slice(at, PACK)
                x, windows = _matrix(batch.column("v"), width), batch.column("windows").to_pylist()
                low = [-np.inf if s is None else float(s) for s in batch.column("low").to_pylist()]
                scores = [[window_of(s, low_percent) for s in w] for w in windows]
                ends = [(min(a for a, _ in w), max(b for _, b in w)) if w else (b, np.inf) for w, b in zip(scores, low, strict=True)]
                inner, outer = np.array([annulus(q2, router.value.most, a, b) for q2, (a, b) in zip((x * x).sum(1), ends, strict=True)]).T
                closest, furthest = router.value.reach(x)
                goes = (closest * (1 - MARGIN) - MARGIN <= outer[:, None]) & (furthest * (1 + MARGIN) + MARGIN >= inner[:, None])
                if to != "all":
                    own = router.value.route(x)[:, None] == np.arange(goes.shape[1])
                    goes &= own if to == "own" else ~own
                ids, labels, values = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), x.astype(np.int32)
                rows = []
                for leaf in np.flatnonzero(goes.any(0)).tolist():
                    i = np.flatnonzero(goes[:, leaf])
                    pack = (ids[i].tobytes(), labels[i].tobytes(), values[i].tobytes(), [low[j] for j in i], [windows[j] for j in i])
                    rows += [(leaf, piece, int(ids[0] // PACK % parts), *pack) for piece in range(pieces.get(leaf, 0))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["leaf", "piece", "part", "ids", "labels", "x", "low", "windows"])

    return anchors.select("vec_id", "label", "v", "low", "windows").mapInArrow(run, "leaf int, piece int, part int, ids binary, labels binary, x binary, low array<double>, windows array<array<long>>")


def _search(visits: DataFrame, blocks: DataFrame, parts: int, width: int, most: float, k: int, low_percent: int) -> DataFrame:
    """What packs find in a block: (anchor_id, slot, score, vec_id); slot: which window, 0 for positives.

    The packs that come to a block are dealt to so many parts that one holds PART anchors or so.
    """

    def run(packs: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if packs.num_rows and held.num_rows:
            block = _block(held["parts"][0].as_py(), width, most)
            for pack in packs.to_pylist():
                ids, labels, x = np.frombuffer(pack["ids"], np.int64).tolist(), np.frombuffer(pack["labels"], np.int32).tolist(), np.frombuffer(pack["x"], np.int32).reshape(-1, width).astype(float)
                for vec_id, label, q, low, windows in zip(ids, labels, x, pack["low"], pack["windows"], strict=True):
                    found = block.negatives(q, label, [window_of(s, low_percent) for s in windows], k) if windows else [block.top(q, label, vec_id, k, low)]
                    out += [(vec_id, i, s, n) for i, some in enumerate(found) for s, n in some]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "score", "vec_id"])

    keys = ["leaf", "piece", "part"]
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return visits.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, "anchor_id long, slot int, score long, vec_id long")


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of each key by score and vec_id, with their rank; Spark keeps k of each key before it shuffles."""
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 5, low_percent: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id, label, embedding). anchors: which rows are anchors, by vec_id. Of each anchor the first
    `positives` other rows of its label, and for each the first k rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, scale), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    n, most, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    width, most = max(1, width or 0), float(most or 0)
    size = min(SAMPLE, max(64, SAMPLE_VALUES // width))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("v").toArrow().column(0).combine_chunks()
    leaf = max(16, -(-len(sample) * BLOCK // max(1, n)))  # a leaf holds a block's share of rows, if the sample allows it
    made = Router(_matrix(sample, width), most, leaf)
    router = spark.sparkContext.broadcast(made)  # bounded by the sample

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, count = np.unique(router.value.route(_matrix(batch.column("v"), width)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(count, pa.int64())], ["leaf", "n"])

    sizes = {r["leaf"]: r["n"] for r in rows.select("v").mapInArrow(leaves, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}  # a row for a leaf
    pieces = {i: -(-c // BLOCK) for i, c in sizes.items()}
    blocks = cut(_blocks(rows, router, pieces, width, most), "blocks")

    chosen = cut(rows.where(anchors), "anchors")
    parts = max(1, -(-chosen.count() // PART))

    def search(asked: DataFrame, to: str, k: int) -> DataFrame:
        return _search(_visits(asked, router, pieces, parts, width, to, low_percent), blocks, parts, width, most, k, low_percent)

    none = F.array().cast("array<long>").alias("windows")
    near = cut(_first(search(chosen.select("*", F.lit(None).cast("long").alias("low"), none), "own", positives), positives, "anchor_id"), "near")
    bound = near.groupBy("anchor_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("low"))
    rest = chosen.join(bound, chosen["vec_id"] == bound["anchor_id"], "left").select("vec_id", "label", "v", "low", none)
    best = _first(near.drop("rank").union(search(rest, "others", positives)), positives, "anchor_id")
    best = cut(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("w"))  # `positives` at most
    windows = windows.select("anchor_id", F.transform("w", lambda x: x["positive_score"]).alias("windows"))
    asked = chosen.join(windows, chosen["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", F.lit(None).cast("long").alias("low"), "windows")
    found = _first(search(asked, "all", k), k, "anchor_id", "slot")
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS l, b.vec_id AS other, b.label AS m, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE l = m
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND l <> m AND 80 * positive_score <= 100 * score AND score <= positive_score
) WHERE rank <= 5
"""
