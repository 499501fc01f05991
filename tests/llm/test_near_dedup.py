import random

import duckdb
import pytest

from fieldsieve.llm import near_dedup as D
from fieldsieve.llm.components import components
from fieldsieve.llm.shingles import split

from .conftest import frame, prose


def brute(rows):
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
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if root(j) == root(i) and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in D.linked(df).collect()), key=str)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    kept = D.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 7 not in ids and 6 in ids


def test_one_id_with_several_texts(spark):
    """Whatever the order of rows, the same text stays."""
    rng = random.Random(9)
    rows = [(1, prose(rng, 40), "a"), (1, prose(rng, 40), "b"), (1, prose(rng, 40), "c"), (2, prose(rng, 40), "d")]
    kept = [sorted((r["doc_id"], r["text"], r["a b"]) for r in D.deduplicated(spark.createDataFrame(order, "doc_id long, text string, `a b` string")).collect()) for order in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2] and kept[0][0] in rows


def test_empty(spark, empty):
    assert D.linked(empty).count() == 0 and D.deduplicated(empty).count() == 0


@pytest.mark.parametrize("short", [1, 2, 16])
def test_groups_of_edited_copies(spark, monkeypatch, short):
    """Long lists take another way; the links are the same."""
    monkeypatch.setattr(D, "SHORT", short)
    rng = random.Random(short)
    texts = []
    for _ in range(6):
        base = prose(rng, 90).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = prose(rng, 40)
    texts += [passage + " " + prose(rng, rng.randint(3, 60)) for _ in range(30)]
    rng.shuffle(texts)
    df = frame(spark, texts)
    assert got(df) == brute(list(enumerate(texts)))


def test_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted(tuple(r) for r in c.execute(f"select doc_id, n_shingles, component_id, kept from ({D.OP7_SQL})").fetchall())
    rows = D.op7_near_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in rows) == expected


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(6, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (6, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: root(x) for x in parent}
    assert components(df.where("false")).count() == 0


def test_stars_are_not_gone_over_again(spark, monkeypatch):
    """What is settled is seen without another round, and links that were joined once come back as stars."""
    from fieldsieve.llm import components as C

    rounds, star = [], C._star
    monkeypatch.setattr(C, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    path = [(1, 2), (2, 3), (2, 3), (3, 2)]
    assert sorted(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert len(rounds) == 2
    hub = [(9, i) for i in range(10, 30)] + [(40, 31)]
    assert len(components(spark.createDataFrame(hub, "a long, b long")).collect()) == 23
    assert len(rounds) == 2
