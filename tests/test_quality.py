"""The rules on small frames with known rows."""

import pytest

from fieldsieve.operators import quality as Q

FISH, OTHER = "Chordata", "Echinodermata"


def frame(spark, schema, *columns):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(zip(*columns, strict=True))], "rowid long, " + schema)


def rows(df, rule):
    return sorted(r["rowid"] for r in Q.rows_flagged(df, rule).collect())


def test_fish_over(spark):
    total = [100.0, 100.5, 101.0, None, float("nan"), 1e6, 0.0, -3.0]
    limit = lambda phylum, **k: rows(frame(spark, "total double, phylum string", total, phylum), Q.fish_over(**k))
    assert limit([FISH] * 8) == [2, 3, 6]
    assert limit([OTHER] * 8) == limit([None] * 8) == []
    assert limit([FISH, OTHER] * 4) == [3]
    assert limit([FISH] * 8, limit=-1) == [1, 2, 3, 6, 7]


def test_total_zero(spark):
    assert rows(frame(spark, "total double", [0.5, 7.25]), Q.total_zero()) == []
    assert rows(frame(spark, "total double", [0.0, -0.0, 1e-9, None, float("nan"), 3.0]), Q.total_zero()) == [1, 2]


def test_inverts(spark):
    phylum = [OTHER, OTHER, OTHER, FISH, None, FISH]
    df = frame(spark, "inverts double, phylum string", [20.0, 20.5, None, 0.0, 90.0, 0.25], phylum)
    assert rows(df, Q.inverts_over()) == [2]
    assert rows(df, Q.vertebrate_with_invertebrate_count()) == [6]
    df = frame(spark, "inverts string, phylum string", ["9", "20.01", "many", None, "  21", "21"], [OTHER] * 5 + [FISH])
    assert rows(df, Q.inverts_over()) == [2, 5]  # text is compared as numbers


def test_least_flag_needs_no_shuffle(spark):
    df = frame(spark, "total double, inverts double, phylum string", [0.0, 150.0, 5.0, None, 0.0], [30.0, 1.0, 0.0, 25.0, 0.0], [OTHER, FISH, FISH, OTHER, None])
    rules = [Q.total_zero(), Q.inverts_over(), Q.fish_over(), Q.vertebrate_with_invertebrate_count()]
    one = Q.flag_priority(df, rules)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, Q.first_flag(Q.flags(df, rules)).collect())) == [(1, 5), (2, 3), (4, 7), (5, 5)]
    assert sorted(map(tuple, Q.flagged(df, rules).collect()), key=str) == sorted(map(tuple, Q.with_flags(df, one).collect()), key=str)
    for out in (one, Q.flagged(df, rules, flagged_only=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert [r["test_id"] for r in Q.flagged(df, []).collect()] == [None] * 5


def test_sizes_with_dots(spark):
    df = frame(spark, "phylum string, `2.5` int, `5` int, `125` int", ["Mollusca", "Mollusca", "Chordata", None], [None, 1, 1, 1], [0, 0, 1, 1], [4, 0, 0, 0])
    assert rows(df, Q.invertebrate_with_sizes(["2.5", "5"])) == [2]
    assert rows(df, Q.invertebrate_with_sizes(["2.5", "5"], include_125=True)) == [1, 2]


def test_missing(spark):
    df = frame(spark, "vis string, depth double", ["BLANK", "", None, "5", "blank"], [1.0, 2.0, 3.0, None, float("nan")])
    assert rows(df, Q.missing_metadata(["vis", "depth"])) == [1, 3, 4]
    assert rows(frame(spark, "taxonomic_id int", [1, None, -5]), Q.missing_taxonomic_id()) == [2]
    text = frame(spark, "taxonomic_id string", ["1", "x", None])
    assert rows(text, Q.missing_taxonomic_id()) == [2, 3]
    assert rows(text, Q.missing_taxonomic_id(strict=True)) == [1, 2, 3]


def test_guard_names_columns(spark):
    with pytest.raises(ValueError, match="phylum"):
        Q.rows_flagged(frame(spark, "total double, pylum string", [1.0], ["x"]), Q.fish_over())


def test_flags_in_one_scan(spark, sf):
    df = frame(spark, "total double, phylum string, inverts double", [0.0, 500.0, 3.0], ["Chordata", "Chordata", "x"], [2.0, 0.0, 50.0])
    rules = [Q.vertebrate_with_invertebrate_count(), Q.total_zero(), Q.fish_over(), Q.inverts_over()]
    found = Q.flags(df, rules)
    assert sorted((r["row_num"], r["test_id"]) for r in found.collect()) == [(1, 3), (1, 5), (2, 6), (3, 7)]
    assert sorted((r["row_num"], r["test_id"]) for r in Q.first_flag(found).collect()) == [(1, 3), (2, 6), (3, 7)]
    assert Q.run_all(df, "unknown").count() == 0
    plan = Q.flags(spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("value", "total"), [Q.total_zero(), Q.total_zero()], "event_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_stream(spark, tmp_path):
    from fieldsieve.streaming.flags import stream_flags

    frame(spark, "total double", [0.0, 1.0, 0.0]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rowid long, total double").parquet(str(tmp_path / "in"))
    run = stream_flags(stream, [Q.total_zero()], "rowid").writeStream.format("memory").queryName("flags_out").start()
    try:
        run.processAllAvailable()
        assert sorted(r["row_num"] for r in spark.table("flags_out").collect()) == [1, 3]
    finally:
        run.stop()
