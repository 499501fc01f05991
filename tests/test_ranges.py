"""Row numbers, run lengths and ordered texts: any type, any skew, and the same results as plain Python."""

import datetime
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from fieldsieve.operators.rowid import FILE, in_ranges, ordered_join, run_lengths, with_rowid

KINDS = {
    "one_value": lambda i, r: "same",
    "all_null": lambda i, r: None,
    "common_prefix": lambda i, r: f"a very long common beginning {r.randrange(10**6):07d}",
    "half_null": lambda i, r: None if i % 2 else f"v{r.randrange(50)}",
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_no_range_over_twice_its_share(spark, kind):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, KINDS[kind](i, rng)) for i in range(4000)], "i long, v string").repartition(3)
    sizes = [r["n"] for r in in_ranges(df, ["v"]).groupBy(FILE).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_numbers_follow_the_order(spark, kind):
    rng = random.Random(4)
    rows = [(i, KINDS[kind](i, rng)) for i in range(1500)]
    got = sorted((r["rowid"], r["v"]) for r in with_rowid(spark.createDataFrame(rows, "i long, v string"), ["v"]).collect())
    assert [n for n, _ in got] == list(range(1, 1501))
    assert [v for _, v in got] == sorted((v for _, v in rows), key=lambda v: (v is not None, v or ""))
    both = with_rowid(spark.createDataFrame(rows, "i long, v string"), ["v", "i"]).orderBy("rowid").collect()
    assert [r["i"] for r in both] == [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))]


def test_other_types(spark):
    rows = [(d, b, a) for d in (None, datetime.date(2020, 1, 2), datetime.date(1999, 5, 5)) for b in (None, True, False) for a in (None, [1, 2], [1], [])]
    df = spark.createDataFrame(rows, "`a date` date, b boolean, a array<int>")
    got = [(r[0], r[1], r[2]) for r in with_rowid(df, ["a date", "b", "a"]).orderBy("rowid").collect()]
    least = lambda v: (v is not None, v if v is not None else 0)
    assert got == sorted(rows, key=lambda r: tuple(map(least, r)))
    assert with_rowid(df.where("false"), ["b"]).count() == 0


def test_numbering_takes_one_shuffle_and_no_window_over_rows(spark):
    plan = with_rowid(spark.range(1000).withColumn("v", F.col("id") % 7), ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Window [") <= 2


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_runs_against_plain_python(spark, groups):
    rng = random.Random(groups)
    rows = [(rng.randrange(groups) if groups > 1 else 0, i, rng.choice([True, True, True, None, False]) if i % 700 < 600 else True) for i in range(3000)]
    got = sorted(map(tuple, run_lengths(spark.createDataFrame(rows, "k int, t long, v boolean").repartition(4), F.col("v"), "t", ["k"]).collect()), key=str)
    expected = []
    for k in sorted({r[0] for r in rows}):
        for value, run in groupby(sorted(r for r in rows if r[0] == k), key=lambda r: r[2]):
            run = list(run)
            expected.append((k, value, run[0][1], run[-1][1], len(run)))
    assert got == sorted(expected, key=str)


def test_a_run_over_many_ranges(spark):
    rows = [(0, i, False) for i in range(5)] + [(0, i, True) for i in range(5, 3000)] + [(1, i, True) for i in range(50)]
    got = sorted(map(tuple, run_lengths(spark.createDataFrame(rows, "k int, t long, v boolean"), F.col("v"), "t", ["k"]).collect()))
    assert got == [(0, False, 0, 4, 5), (0, True, 5, 2999, 2995), (1, True, 0, 49, 50)]
    assert run_lengths(spark.createDataFrame([], "k int, t long, v boolean"), F.col("v"), "t", ["k"]).count() == 0


def test_texts_of_a_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(10**6), f"w{i}" if i % 11 else None) for i in range(3000)] + [(None, 1, "a"), (None, 0, "b"), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(4)
    got = {r["k"]: r["v"] for r in ordered_join(df, ["k"], "v", ["o", "v"]).collect()}
    expected = {"none": []}
    for k, _, v in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or "", r[1], r[2])):
        expected.setdefault(k, []).append(v)
    assert got == {k: ", ".join(v) for k, v in expected.items()}
    hot = in_ranges(df, ["k", "o"]).where("k = 'hot'").select(FILE).distinct().count()
    assert hot > 1  # its sort is split
    with pytest.raises(Exception, match="over 100 characters"):
        ordered_join(df, ["k"], "v", ["o"], most=100).collect()
