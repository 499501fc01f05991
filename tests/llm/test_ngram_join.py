import random

import pytest

from fieldsieve.llm import ngram_join as G
from fieldsieve.llm.shingles import split

from .conftest import frame, prose


def brute(rows, percent=80):
    """component_id and set size by comparing every two documents."""
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if root(j) == root(i) and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in G.linked(df).collect()), key=str)


def test_odd_rows(spark, odd):
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty(spark, empty):
    assert G.linked(empty).count() == 0


def groups(rng):
    """Edited copies at and around the bound, exact copies, a passage in many texts, and texts made of frequent shingles alone."""
    texts = []
    for _ in range(6):
        base = prose(rng, 90).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 8
    passage = prose(rng, 40)
    texts += [passage + " " + prose(rng, rng.randint(1, 30)) for _ in range(40)]
    texts += [" ".join(passage.split()[: rng.randint(28, 40)]) for _ in range(12)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("short,chunk,ranges,hot", [(16, 1 << 21, 1 << 20, 4096), (2, 500, 700, 12), (4, 3000, 900, 30), (1, 200, 5000, 5)])
def test_groups_of_edited_copies(spark, monkeypatch, short, chunk, ranges, hot):
    """Long lists, many chunks and ranges, and very frequent shingles take other ways; the links are the same."""
    for name, value in {"SHORT": short, "CHUNK": chunk, "RANGE": ranges, "HOT_LEAST": hot, "LOCAL_LEAST": 2}.items():
        monkeypatch.setattr(G, name, value)
    texts = groups(random.Random(short))
    assert got(frame(spark, texts).repartition(5)) == brute(list(enumerate(texts)))


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = G.op11_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_pairs_at_the_bound(spark):
    """Eight of ten shingles in common link, seven of ten do not; a pair meets once however many shingles it shares."""
    words = [f"v{i}" for i in range(13)]
    near = " ".join(words[:12])  # 8 shingles of the 9 of all 13
    at = [" ".join(words), near, " ".join([*words[:8], "z"])]
    assert got(frame(spark, at)) == brute(list(enumerate(at)))
    df = frame(spark, [near, near + " v13", near + " v14"])
    entries = spark.createDataFrame([(v, n, 10, r) for n in (1, 2) for r, v in enumerate((5, 6, 7))], "value long, node long, size long, rank long")
    assert [tuple(r) for r in G._pairs(entries, 80).collect()] == [(1, 2)] and df.count() == 3
    late = spark.createDataFrame([(5, 1, 10, 0), (5, 2, 10, 4), (5, 3, 30, 0)], "value long, node long, size long, rank long")
    assert G._pairs(late, 80).count() == 0  # too few shingles follow; too unlike in length


def test_suffix_filter(spark):
    """Sets whose parts of the hash range are unlike are out, no pair at the bound is."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [base, np.concatenate([base[:95], rng.integers(0, 2**64, 5, dtype=np.uint64)]), rng.integers(0, 2**58, 100, dtype=np.uint64)]
    df = spark.createDataFrame([(i, bytearray(np.unique(s).tobytes())) for i, s in enumerate(sets)], "node long, set binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert [tuple(r) for r in G._suffix(pairs, df, 80).collect()] == [(0, 1)]
