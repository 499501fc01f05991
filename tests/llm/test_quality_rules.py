import collections
import random
import re

from fieldsieve.llm import quality_rules as Q

from .conftest import SCHEMA, prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, odd):
    rows = Q.judge(odd, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        expected = brute(r["text"])
        assert tuple(r[c] for c in Q.BASE) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_empty(spark, empty):
    assert Q.judge(empty, ["doc_id"]).count() == 0
    assert Q.filter_quality(empty).columns == empty.columns


def test_overlapping_repeats(spark):
    texts = ["a b c d e f g h i " * 3, "a " * 40, "\n".join(["same line of words here"] * 9), "p q r s t u v w x p q r s t u v w y"]
    df = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in Q.judge(df, ["doc_id"]).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_stays(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0  # a quarter is junk, which plain means and covariances would not survive
        text = prose(rng, rng.randint(30, 300))
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split()) if bad else text, "en", f"s{i % 2}", 1, None, 1, "n", 1.0, "b"))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in Q.filter_quality(df).collect()}
    assert kept == {i for i in range(400) if i % 4}
    assert Q.filter_quality(df).columns == df.columns


def test_scale_comes_from_the_group(spark):
    """Long texts of a narrow group: a share of signs that the group itself never has is an outlier, however small its size."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        w = prose(rng, 400).split()
        for k in range(8 * (i % 10 == 0)):
            w[k * 40] += "###" * 4  # a twentieth of the characters
        rows.append((i, " ".join(w), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in Q.judge(df, ["doc_id"]).collect() if not r["kept"]} == {i for i in range(120) if i % 10 == 0}


def test_steps_settle_at_the_core(spark):
    """Against the definition: the half that is kept has the least determinant, whatever a tight cluster of others looks like."""
    import numpy as np

    rng = np.random.default_rng(7)
    core, far = rng.normal(0, 0.05, (300, 6)) + 0.5, rng.normal(0, 0.01, (120, 6)) + 1.5
    df = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([core, far])], "__g string, " + ", ".join(f"{x} double" for x in Q.FEATURES))
    r = Q.estimate(df).first()
    assert all(abs(m - 0.5) < 0.02 for m in r["m"])
    assert all(r["c"][i][i] < 0.05**2 + (Q.RIDGE * 0.5) ** 2 for i in range(6))


def plain_mcd(x, ridge, starts, rng):
    """The least log determinant, ridge included, over halves reached from many random subsets by concentration."""
    import numpy as np

    best = (np.inf, None, None)
    for _ in range(starts):
        half = rng.choice(len(x), 10, replace=False)
        last = np.inf
        while True:
            m, c = x[half].mean(axis=0), np.cov(x[half].T, bias=True) + np.diag(ridge)
            ld = np.linalg.slogdet(c)[1]
            if len(half) > 10:
                best = min(best, (ld, tuple(m), c.tobytes()))
                if ld > last - 1e-9:
                    break
                last = ld
            d = x - m
            half = np.argsort((d @ np.linalg.inv(c) * d).sum(axis=1))[: (len(x) + 1) // 2]
    return best[0], np.array(best[1])


def test_the_determinant_is_as_small_as_a_plain_search_finds(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = []
    data = {}
    for g in range(3):
        mix = rng.normal(0, 1, (6, 6))
        data[f"g{g}"] = np.concatenate([rng.normal(0, 0.1, (400, 6)) @ mix + g, rng.normal(0, 0.3, (120, 6)) + 2 + g])
        rows += [(f"g{g}", *map(float, v)) for v in data[f"g{g}"]]
    df = spark.createDataFrame(rows, "__g string, " + ", ".join(f"{x} double" for x in Q.FEATURES))
    for r in Q.estimate(df).collect():
        x = data[r["__g"]]
        least, centre = plain_mcd(x, x.var(axis=0) * Q.RIDGE**2 + Q.TINY, 60, rng)
        assert abs(np.linalg.slogdet(np.array(r["c"]))[1] - least) < 0.2  # the half is exact to a step of the histogram
        assert np.abs(np.array(r["m"]) - centre).max() < 0.05


def test_distances_are_those_of_the_estimate(spark):
    import numpy as np

    rng = random.Random(4)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(25, 200)) + " #" * (i % 3), "en", "s") for i in range(150)], "doc_id long, text string, lang string, source string")
    stats = [r.asDict() for r in Q.with_statistics(df, ["doc_id"]).collect()]
    rows = spark.createDataFrame([("g", *[float(r[x]) for x in Q.FEATURES]) for r in stats if not r["base_failed"]], "__g string, " + ", ".join(f"{x} double" for x in Q.FEATURES))
    e = Q.estimate(rows).first()
    found = {r["doc_id"]: r["d2"] for r in Q.judge(df, ["doc_id"]).collect()}
    for r in stats:
        off = np.array([r[x] for x in Q.FEATURES]) - np.array(e["m"])
        cov = e["__c"] * np.array(e["c"]) + np.diag([r[v] for v in Q.NOISE])
        assert abs(found[r["doc_id"]] - off @ np.linalg.solve(cov, off)) < 1e-6 * max(1, found[r["doc_id"]])


def test_small_groups_are_pooled(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, prose(rng, 50), "en", f"s{i}") for i in range(30)], "doc_id long, text string, lang string, source string")
    rows = Q.judge(df, ["doc_id"]).collect()
    assert all(r["kept"] and r["d2"] is None for r in rows)


def test_no_python_in_the_plan(spark, sf):
    plan = Q.op1_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
