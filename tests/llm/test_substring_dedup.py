import random

import pytest

from fieldsieve.llm import substring_dedup as S
from fieldsieve.llm.shingles import line_hashes

from .conftest import frame, prose


def unlike(rng, n):
    return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))


def test_marks_do_not_depend_on_neighbours():
    rng = random.Random(0)
    texts = [prose(rng, n) for n in (0, 1, 3, 16, 17, 50, 400, 7)] + [None, "one " * 60]
    hashes, starts, _ = line_hashes(texts)
    word, _ = S.marks(hashes, starts)
    for i, t in enumerate(texts):
        alone, own = S.marks(*line_hashes([t])[:2])[0], (word >= starts[i]) & (word < starts[i + 1])
        every = S.windows(hashes[starts[i] : starts[i + 1]], S.MARK).tolist()
        runs = [every[k : k + S.REACH] for k in range(max(1, len(every) - S.REACH + 1))] if every else []
        if i != len(texts) - 1:  # in the last all windows are equal
            assert (word[own] - starts[i]).tolist() == alone.tolist() == sorted({every.index(min(r)) for r in runs})
        assert all(min(r) in {every[k] for k in alone} for r in runs)


def test_a_passage_always_has_a_mark():
    rng = random.Random(1)
    passage = unlike(rng, S.MARK + S.REACH - 1)
    for _ in range(30):
        found = []
        for _ in range(2):
            hashes, starts, _ = line_hashes([unlike(rng, rng.randint(0, 60)) + " " + passage + " " + unlike(rng, rng.randint(0, 60))])
            found.append(set(S.marks(hashes, starts)[1].tolist()))
        assert found[0] & found[1]


@pytest.mark.parametrize("short", [2, 16])
def test_passages(spark, monkeypatch, short):
    monkeypatch.setattr(S, "SHORT", short)
    rng = random.Random(4)
    passages = [unlike(rng, 60) for _ in range(12)]
    texts, holds = [], []
    for i in range(60):
        has = i % 12 if i % 5 < 3 else None
        parts = [unlike(rng, rng.randint(5, 80)), *([passages[has]] if has is not None else []), unlike(rng, rng.randint(5, 80))]
        texts.append((" " if i % 2 else "\n").join(parts))
        holds.append(has)
    first = {}
    for i, h in enumerate(holds):
        first.setdefault(h, i)
    counts = {h: holds.count(h) for h in holds}
    df = frame(spark, texts)
    rows = S.repeated(df).collect()
    again = {i for i, h in enumerate(holds) if h is not None and first[h] != i}
    assert {r["doc_id"] for r in rows if r["removed"]} == again
    assert {r["doc_id"] for r in rows} == {i for i, h in enumerate(holds) if h is not None and counts[h] > 1}
    assert all(holds[r["doc_id"]] == holds[r["first_doc_id"]] for r in rows)
    out = S.without_repeats(df)
    assert out.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in enumerate(texts):  # runs reach the passage's true edges; a near paragraph goes with its few other words
        own = set(passages[holds[i]].split()) if i in again else set()
        assert not own & set(left[i].split())
        assert len(t.split()) - len(left[i].split()) - len(own) <= 20 * bool(own)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_near_paragraphs_go(spark):
    """A paragraph with one or two changed words in its middle is removed whole, not only its equal parts."""
    rng = random.Random(9)
    lines = [unlike(rng, 60) for _ in range(20)]
    other = [edited(rng, x, 1 + i % 2) for i, x in enumerate(lines)]
    docs = frame(spark, [unlike(rng, 30) + "\n" + x + "\n" + unlike(rng, 30) for x in lines + other])
    rows = S.repeated(docs).where("removed").collect()
    near = {i for i, (x, y) in enumerate(zip(lines, other, strict=True)) if jaccard(x, y) >= 0.75}
    assert len(near) > 9
    assert {(r["doc_id"], r["first_doc_id"], r["start"], r["n_words"]) for r in rows} >= {(i + 20, i, 30, 60) for i in near}


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y)


def test_paragraph_classes_against_all_pairs(spark):
    rng = random.Random(12)
    lines = [unlike(rng, rng.randint(8, 110)) for _ in range(80)]
    lines += [edited(rng, x, rng.randint(0, 6)) for x in lines for _ in range(3)]
    near = {(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.75}
    assert S.tuned(75) == 6
    docs = frame(spark, lines).select("doc_id", "text")
    units = S._units(docs, S.tuned(75))
    node = {r["doc_id"]: r["node"] for r in units.where(units["kind"] == S.PARAGRAPH).collect()}
    component = {r["node"]: r["component"] for r in S._near(docs, units, 75).collect()}
    cluster = {i: component.get(node[i], node[i]) for i in node}
    assert len(near) > 100
    assert sum(cluster[i] == cluster[j] for i, j in near) >= 0.97 * len(near)
    groups = {}
    for i, j in near:  # nothing else is joined: clusters lie inside the components of all true pairs
        groups.setdefault(i, {i}).add(j), groups.setdefault(j, {j}).add(i)
    seen = {}
    for i in range(len(lines)):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += groups.get(x, ())
    for i in range(len(lines)):
        assert all(seen[j] == seen[i] for j in range(len(lines)) if cluster[j] == cluster[i])


def test_hash_is_that_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from fieldsieve.llm.bitmaps import xxhash64

    a, b = np.array([0, -1, 5, 2**62, -(2**63)]), np.array([1, 7, -3, 0, 2**63 - 1])
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert [r[0] for r in df.coalesce(1).select(F.xxhash64("a", "b")).collect()] == xxhash64(a, b).tolist()


def test_long_lists_link_what_is_not_near_their_centre(spark):
    """Forty variants share one minimum with the centre only; each is near one other of them, in pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.concatenate([[np.uint64(7)], rng.integers(10, 2**63, 8, dtype=np.uint64)]) for _ in range(41)]
    for i in range(1, 41, 2):
        sets[i + 1] = np.append(sets[i][:-1], np.uint64(rng.integers(10, 2**63)))
    packed = spark.createDataFrame([(i, bytearray(np.sort(x).tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    long = spark.createDataFrame([(7, i) for i in range(41)], "key long, node long")
    centre = spark.createDataFrame([(0, i) for i in range(1, 41)], "a long, b long")
    links = S._apart_links(long, S._confirm(centre, packed, 75), centre, packed, 75)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(i, i + 1) for i in range(1, 41, 2)}


def test_odd_and_empty(spark, odd, empty):
    assert S.repeated(empty).count() == 0 and S.without_repeats(empty).count() == 0
    out = S.without_repeats(odd)
    assert out.count() == odd.count() and out.columns == odd.columns
    rows = {(r["doc_id"], r["first_doc_id"]) for r in S.repeated(odd).where("removed").collect()}
    assert (7, 6) in rows and not any(a is None for a, _ in rows)


def test_rows_of_first_occurrences(spark):
    """One original and one copy of each passage: the row of the original says where it stands there, and lies inside its text."""
    rng = random.Random(11)
    texts, expected = [], {}
    for n in (47, 55, 60, 80, 100, 120, 160, 200, 250, 300):
        passage = prose(rng, n)
        for first in (True, False):
            before, after = rng.randint(20, 60), rng.randint(20, 60)
            lead, tail = [f"a{len(texts)}x{i}" for i in range(before)], [f"b{len(texts)}x{i}" for i in range(after)]
            if first:
                expected[len(texts)] = (before, n)
            texts.append(" ".join([*lead, passage, *tail]))
    rows = S.repeated(frame(spark, texts)).where("NOT removed").collect()
    found = {r["doc_id"]: (r["start"], r["n_words"]) for r in rows}
    assert len(rows) == len(found) and all(r["start"] + r["n_words"] <= len(texts[r["doc_id"]].split()) for r in rows)
    assert set(found) == set(expected)
    # the paragraph around a passage may be near as a whole, and then is the row; otherwise the row is the passage
    for doc, (start, n) in expected.items():
        assert found[doc][0] <= start and sum(found[doc]) >= start + n and found[doc][1] * 3 <= n * 4
    assert sum(found[doc] == expected[doc] for doc in expected) >= 9


def test_clashing_names(spark):
    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 30)} q{i} {passage}", "g", i, "s") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone string, __doc int, start string")
    out = {r["doc_id"]: r for r in S.without_repeats(df).collect()}
    assert S.without_repeats(df).columns == df.columns and out[0]["text"] == rows[0][1] and passage not in out[1]["text"] and out[2]["__doc"] == 2


def test_variants_of_one_paragraph_meet_their_centre(spark, monkeypatch):
    """Sixty variants are near to one paragraph and mostly not to each other: few pairs of them are compared, and all come together."""
    rng = random.Random(21)
    hub = unlike(rng, 100)
    texts = [hub] + [" ".join(f"e{i}x{k}" if k in (20 + i % 7, 70 + i % 11) else w for k, w in enumerate(hub.split())) for i in range(60)]
    assert all(jaccard(hub, t) >= 0.75 for t in texts) and sum(jaccard(x, y) >= 0.75 for x in texts[1:] for y in texts[1:] if x != y) < 1000
    found, pairs = [], S._prefix_pairs

    def counted(*a):
        out = pairs(*a)
        found.append(out.distinct().count())
        return out

    monkeypatch.setattr(S, "_prefix_pairs", counted)
    docs = frame(spark, texts).select("doc_id", "text")
    near = S._near(docs, S._units(docs, S.tuned(75)), 75).collect()
    assert len(near) == 61 and len({r["component"] for r in near}) == 1
    assert sum(found) <= 61


def test_contexts_of_places_where_units_end(spark):
    """Even a bitmap that has every place asks for no more than the edges of units."""
    import numpy as np

    rng = random.Random(22)
    texts = [unlike(rng, n) for n in (300, 40, 17, 3)] + ["", None, unlike(rng, 30) + "\n" + unlike(rng, 50)]
    docs = frame(spark, texts).select("doc_id", "text")
    units = {(r["doc_id"], r["start"], r["words"]) for r in S._units(docs, 1).collect()}
    every = spark.sparkContext.broadcast(np.full(1 << 20, np.iinfo(np.uint64).max, np.uint64))
    rows = S._contexts(docs, every).collect()
    got = {(r["doc_id"], r["at"], r["side"]): len(r["words"]) // 4 for r in rows}
    assert len(got) == len(rows) <= 2 * len(units) + 2 < sum(len((t or "").split()) for t in texts) / 2
    for doc, start, words in units:
        assert got[doc, start, S.LEFT] == min(start, S.CONTEXT)
        assert got[doc, start + words, S.RIGHT] == min(len(texts[doc].split()) - start - words, S.CONTEXT)
