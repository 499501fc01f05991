import random

import pytest

from fieldsieve.llm import decontamination as D

from .conftest import frame, prose


def brute_tiles(doc, item, least):
    """Greedy tiling by looking at all places again for every tile."""
    marked_d, marked_p, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not marked_d[i + n] and not marked_p[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            marked_d[i + k] = marked_p[j + k] = True
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(30))
def test_tiles(seed):
    rng = random.Random(seed)
    alphabet = [bytes([97 + i]) for i in range(2 + seed % 4)]
    doc, item = ([rng.choice(alphabet) for _ in range(rng.randint(0, 30))] for _ in range(2))
    assert sum(n for *_, n in D.tiles(doc, item, 3)) == sum(n for *_, n in brute_tiles(doc, item, 3))


def test_reordered_and_clean(spark, odd):
    rng = random.Random(8)
    items = [prose(rng, 40) for _ in range(5)] + ["too short", None, ""]
    w = items[0].split()
    turned = " ".join(w[20:] + ["between"] + w[:20])
    texts = ["pre " * 10 + items[1] + " post", turned, prose(rng, 300), items[2].upper().replace(" ", "!! "), " ".join(items[3].split()[:12]), None, "", prose(rng, 50) + "\n" + items[4].replace(" ", "\n")]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]): r["covered"] for r in D.contaminated(docs, bench).collect()}
    assert found == {(0, 1): 40, (1, 0): 40, (3, 2): 40, (7, 4): 40}
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6}
    assert D.decontaminated(odd, bench).count() == odd.count()
    assert D.contaminated(docs.where("false"), bench).count() == 0
    assert D.contaminated(docs, bench.where("false")).count() == 0


def test_rows_without_id_and_repeated(spark):
    text = prose(random.Random(1), 30)
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()), key=str) == [(1, 9), (None, 9)]
    assert [tuple(r) for r in D.decontaminated(docs, bench).collect()] == [(1, "other")]
