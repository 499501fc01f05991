import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsieve.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, low string, v string, leaf int, `a b` string"


def brute(rows, anchors, positives=5, k=5, low_percent=80, scale=256):
    """The contract by scoring every two rows."""
    held = {}
    for vec_id, x, label in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            row = (label, [math.floor(scale * c) for c in x])
            held[vec_id] = min(held.get(vec_id, row), row)
    out = []
    for q in [i for i in held if anchors(i)]:
        scored = sorted((-sum(a * b for a, b in zip(held[q][1], x, strict=False)), i, label) for i, (label, x) in held.items() if i != q)
        for s, p in [(-s, i) for s, i, label in scored if label == held[q][0]][:positives]:
            fit = [(-t, i) for t, i, label in scored if label != held[q][0] and low_percent * s <= -100 * t <= 100 * s]
            out += [(q, p, r + 1, i, s, t) for r, (t, i) in enumerate(fit[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, x, n, "a", "b", 1, None) for i, x, n in rows], SCHEMA)


def got(df, anchors, **more):
    return sorted(map(tuple, H.mined(df, anchors, **more).collect()))


def cloud(rng, n, width, labels, groups=0):
    """Vectors around some centres, with copies and ties."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(max(1, groups))]
    rows = []
    for i in range(n):
        c = rng.choice(centres) if groups else [0] * width
        x = [a + rng.gauss(0, 0.3) for a in c]
        rows.append((i, x if rng.random() < 0.9 or not rows else rows[rng.randrange(len(rows))][1], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("n,width,labels,groups,block,leaf,part", [(900, 3, 4, 9, 4096, 96, 8192), (700, 2, 3, 5, 40, 5, 20), (500, 16, 10, 0, 64, 8, 50)])
def test_against_brute_force(spark, monkeypatch, n, width, labels, groups, block, leaf, part):
    """Many leaves, pieces and parts give what one block gives."""
    for name, value in {"BLOCK": block, "LEAF": leaf, "PART": part, "PACK": 16}.items():
        monkeypatch.setattr(H, name, value)
    rows = cloud(random.Random(n), n, width, labels, groups)
    assert got(table(spark, rows), F.col("vec_id") % 5 == 0) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = cloud(rng, 120, 4, 3, 2) + [(None, [1.0] * 4, 1), (500, None, 1), (505, [1.0, None, 0.0, 0.0], 1), (510, [1.0, float("nan"), 0.0, 0.0], 1), (515, [float("inf")] * 4, 1), (520, [0.5] * 4, None), (-5, [0.4, 0.1, 0.0, 0.2], 1), (-10, [0.4, 0.1, 0.0, 0.2], 0)]
    rows += [(525, [], 1), (530, [0.3, 0.2], 2), (10, [0.1] * 4, 2), (15, rows[15][1], rows[15][2])]
    assert got(table(spark, rows), F.col("vec_id") % 5 == 0) == brute(rows, lambda i: i % 5 == 0)
    assert got(table(spark, rows), F.col("vec_id") % 5 == 0, positives=2, k=7, low_percent=95) == brute(rows, lambda i: i % 5 == 0, 2, 7, 95)
    assert got(table(spark, []), F.col("vec_id") % 5 == 0) == []
    with pytest.raises(Exception, match="too large"):
        got(table(spark, [(0, [1e9], 0)]), F.lit(True))


def test_copies_of_one_vector(spark, monkeypatch):
    """A leaf that no split divides is dealt to blocks."""
    monkeypatch.setattr(H, "BLOCK", 50)
    rows = [(i, [0.5, -0.25, 0.125], i % 3) for i in range(400)] + cloud(random.Random(2), 100, 3, 3, 2)
    rows = [(i, x, n) for i, (_, x, n) in enumerate(rows)]
    assert got(table(spark, rows), F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_walk_is_nearest_first_and_stops():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 50, (2000, 3)))
    most = float((x * x).sum(1).max())
    block = H.Block(np.arange(2000), rng.integers(0, 4, 2000), x, most)
    q = x[7]
    true = sorted((-int(s), int(i)) for s, i in zip(block.x @ q, block.ids, strict=True))
    assert [(-s, i) for s, i, _ in block.walk(q, -np.inf, np.inf, lambda labels: labels >= 0)] == true
    low, high = 1000, 3000
    assert [(-s, i) for s, i, _ in block.walk(q, low, high, lambda labels: labels >= 0)] == [t for t in true if low <= -t[0] <= high]
    for (least, greatest), looked_at in {(1000, np.inf): 200, (4000, 6000): 1500}.items():
        seen = []
        next(block.walk(q, least, greatest, lambda labels: seen.append(len(labels)) or labels >= 0))  # noqa: B023
        assert sum(seen) < looked_at  # the others were never scored


def test_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    expected = sorted(c.execute(f"select {names} from ({H.OP13_SQL})").fetchall())
    assert sorted(map(tuple, H.op13_hard_negatives(spark, sf).select(*names.split(", ")).collect())) == expected
