import datetime

import pytest
from pyspark.sql import functions as F

from fieldsieve.functions import nulls as N, text as X
from fieldsieve.operators import events as E, ingest as I, joins as J, metrics as M, wrangle as W
from fieldsieve.operators.rowid import with_rowid
from fieldsieve.plans.registry import QUERIES
from fieldsieve.sources.store import KeyedStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "text"), [(5.0, "5"), (5.5, "5.5"), (1e7, "10000000"), (0.1 + 0.2, "0.3"), (-2.25, "-2.25"), (100.0, "100"), (None, None)])
def test_numbers_as_text(spark, value, text):
    assert one(spark, N.fmt_num(F.lit(value).cast("double"))) == text


def test_three_valued_any(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False), (4, None)], "k int, v boolean")
    assert {r["k"]: r["x"] for r in df.groupBy("k").agg(N.any3(F.col("v")).alias("x")).collect()} == {1: True, 2: None, 3: False, 4: None}


def test_null_aggregates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, None)], "k int, v int")
    out = df.groupBy("k").agg(N.sum_na(F.col("v")).alias("s"), N.count_distinct_na(F.col("v")).alias("n")).collect()
    assert sorted((r["k"], r["s"], r["n"]) for r in out) == [(1, 0, 1), (2, 3, 2)]


@pytest.mark.parametrize(("name", "plain", "legacy"), [("Genus sp.", "Genus", "Genus"), ("Genus spp.", "Genus", "Genus"), ("Genus spp", "Genus spp", "Genus"), ("Genus spinosa sp.", "Genus spinosa", "Genusnosa"), ("Genus species", "Genus species", "Genus species")])
def test_suffix(spark, name, plain, legacy):
    assert one(spark, X.strip_rank_suffix(F.lit(name))) == plain
    assert one(spark, X.strip_rank_suffix(F.lit(name), legacy=True)) == legacy


def test_dates_and_paths(spark):
    assert one(spark, X.date_of(F.lit(2024), F.lit(2), F.lit(29))) == datetime.date(2024, 2, 29)
    assert one(spark, X.date_of(F.lit(2023), F.lit(2), F.lit(29))) is None
    assert one(spark, X.base_name(F.lit("/a/b/c.xlsx"))) == "c.xlsx"
    assert one(spark, X.remove_first(F.lit("a.b.b"), ".b")) == "a.b"


@pytest.mark.parametrize("values", [[3, 1, None, 2, 2**40], [], [None], [7, 7, 7]])
def test_rowid_numbers(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int")
    got = {r["i"]: r["rowid"] for r in with_rowid(df, ["v", "i"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_rowid_other_types(spark):
    words = ["b", "", None, "a", "äb", "ab", "a\u0001"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "v string, i int")
    got = {r["i"]: r["rowid"] for r in with_rowid(df, ["v", "i"]).collect()}
    order = sorted(range(len(words)), key=lambda i: (words[i] is not None, (words[i] or "").encode()))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    df = df.select("i", (F.lit("2024-01-01").cast("date") - F.col("i")).alias("d"))
    assert {r["i"]: r["rowid"] for r in with_rowid(df, ["d"]).collect()} == {i: 7 - i for i in range(7)}


def test_join_suffixes_and_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("a", 21)], "k string, v int")
    out = J.left_join_suffixed(left, right, "k")
    assert out.columns == ["k", "v.x", "v.y"]
    assert sorted(((r[0] or "", r[1], r[2]) for r in out.collect()), key=str) == [("", 1, 10), ("a", 2, 20), ("a", 2, 21), ("z", 3, None)]


@pytest.mark.parametrize("sent", [100_000, 2])
def test_hot_keys_are_joined_apart(spark, monkeypatch, sent):
    """As the plain join, whether the lookup's rows of hot keys are sent to every task or to all parts; duplicates and absent keys too."""
    monkeypatch.setattr(J, "MOST_SENT", sent)
    keys = [None] * 300 + ["a"] * 200 + ["gone"] * 100 + [f"k{i % 150}" for i in range(300)]
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string").withColumn("v", F.col("i") * 2)
    right = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4), *[(f"k{i}", i) for i in range(0, 150, 2)]], "name string, v int")
    assert set(J.hot_keys(left, "k", 0.1)) == {None, "a", "gone"}
    got, plain = J.left_join_split(left, right, "k", "name", 0.1), J.left_join_suffixed(left, right, "k", "name")
    assert got.columns == plain.columns == ["i", "k", "v.x", "v.y"]
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 1100
    calm = left.where("k like 'k%'")
    assert J.hot_keys(calm, "k", 0.1) == [] and J.left_join_split(calm, right, "k", "name", 0.1).count() == 300
    assert J.left_join_split(left.where("false"), right, "k", "name").count() == 0


def test_no_hot_key_is_shuffled(spark):
    """Where the lookup isn't broadcast, no task of the shuffled join has much more than its share."""
    keys = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, 7).otherwise(F.col("id"))
    left, right = spark.range(30_000).select(keys.alias("k"), "id"), spark.range(30_000).select(F.col("id").alias("name"), (F.col("id") + 1).alias("w"))
    apart = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in apart}
    for c, v in apart.items():
        spark.conf.set(c, v)
    try:
        out = J.left_join_split(left, right, "k", "name")
        plan = out._jdf.queryExecution().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 30_000 and max(sizes) < 10_000
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_store_is_read_where_the_keys_are(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, F.concat(F.lit("e"), (F.col("id") % 4000).cast("string"))).alias("event"), F.col("id").alias("v"))
    store = KeyedStore(spark, str(tmp_path / "s"), "event")
    store.append(rows.where("v < 15000"))
    store.append(rows.where("v >= 15000"))
    assert spark.read.parquet(store.path).count() == 20_000
    few = spark.createDataFrame([("e7",), ("e8",), (None,), ("no",)], "event string")
    out = store.rows_of(few)
    assert out.columns == ["event", "v"]
    assert sorted(r["v"] for r in out.collect()) == sorted([7 + 4000 * i for i in range(5)] + [8 + 4000 * i for i in range(5)])
    scan = next(x for x in out._jdf.queryExecution().toString().split("\n") if "FileScan parquet" in x)
    assert "PartitionFilters: [isnotnull(__folder" in scan or "PartitionFilters: [__folder" in scan
    assert "In(event, [" in scan
    many = rows.where("v < 3000").select("event")  # more than are named: by folders and range
    expected = rows.join(many.distinct(), "event", "left_semi")
    assert sorted(r["v"] for r in store.rows_of(many).collect()) == sorted(r["v"] for r in expected.collect())
    assert store.rows_of(few.where("event is null")).count() == 0
    df = spark.createDataFrame([("e7", None), ("no", None), (None, None)], "event string, v string")
    assert {(r[0], r[1]) for r in J.fill_metadata(df, store, "event", ["v"]).collect()} == {("e7", "12007"), ("no", None), (None, None)}


def test_orders(spark):
    """Unknown ids come last, and events are in the order of their ids."""
    names = spark.createDataFrame([("b sp.",), ("a",), ("c",)], "scientific_name string")
    known = spark.createDataFrame([("b", "9"), ("c", "2"), ("a", "-999")], "name string, id string")
    assert [r["taxonomic_id"] for r in J.resolve_names(names, known).collect()] == [2, 9, None]
    events = spark.createDataFrame([(s, None, 1.0, 1, 1) for s in "zax"], "site_code string, date date, depth double, method int, block int")
    assert [r["site_code"] for r in E.event_summary(events).collect()] == ["a", "x", "z"]


def test_fill_metadata(spark):
    df = spark.createDataFrame([("e1", "BLANK", 5, None, None), ("e1", "7", None, "n", None), ("e9", None, None, None, None)], "sample_event_id string, vis string, time int, direction string, photoquadrats string")
    store = spark.createDataFrame([("e1", "3", "BLANK", "s", "1"), ("e1", "4", "9", None, None), ("e2", "8", "8", "8", "8")], "sample_event_id string, vis string, time string, direction string, photoquadrats string")
    got = [tuple(r) for r in J.fill_metadata(df, store).orderBy("sample_event_id", "vis").collect()]
    assert got == [("e1", "3", "5", "s", "1"), ("e1", "7", None, "n", "1"), ("e9", None, None, None, None)]


def test_classification_leaves_out_duplicates(spark):
    ranks = spark.createDataFrame([("51", 0, "Kingdom", "Animalia"), ("51", 1, "Phylum", "Mollusca"), ("7", 0, "Kingdom", "A"), ("7", 1, "kingdom", "B")], "id string, ordinal int, rank string, scientificname string")
    assert [tuple(r) for r in J.classification(ranks).select("taxonomic_id", "level", "kingdom", "phylum").collect()] == [(51, "phylum", "Animalia", "Mollusca")]


def test_event_keys(spark):
    df = spark.createDataFrame([("S1", None, 5.0, 1, 2), ("S1", None, 5.0, 1, None), ("S2", datetime.date(2024, 1, 2), None, 2, 1)], "site_code string, date date, depth double, method int, block int")
    got = {r["sample_event_id"]: (r["method_1_block_1"], r["method_1_block_2"], r["method_2_block_1"]) for r in E.event_summary(df).collect()}
    assert got == {"S1_RLS_NA_5": (None, True, False), "S2_RLS_2024-01-02_NA": (False, False, True)}


def sheet(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rowid long, Method string, Total double, `Site No.` string, `P-Qs` string")


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("0, 1, 2", None), ("1", 10.0), ("2", 20.0), ("1", 30.0), ("1", 0.0)], ["1", "2", "1"]),
        ([("0, 1, 2", None), ("0, 1, 2", None), ("1", 10.0), ("2", 0.0), ("1", 30.0), ("1", 0.0), (None, 4.0)], ["1", "2", "1"]),
        ([("1", 0.0), ("2", 0.0)], ["1", "2"]),
        ([("1", 5.0), ("2", 0.0), ("3", None)], ["1", "2", "3"]),
        ([], []),
    ],
)
def test_ingest_reef(spark, rows, kept):
    out = I.ingest(sheet(spark, [(*r, "s", "p") for r in rows]), I.SPECS["reef-survey-plain"], "/x/y/file.xlsx")
    assert [r["method"] for r in out.orderBy("rowid").collect()] == kept
    assert {"site_code", "photoquadrats", "input_filename"} <= set(out.columns)
    assert all(r["input_filename"] == "file.xlsx" for r in out.collect())


def test_ingest_guards_and_families(spark):
    with pytest.raises(ValueError, match="P-Qs"):
        I.ingest(sheet(spark, []).drop("P-Qs"), I.SPECS["reef-survey-plain"], "f")
    df = spark.createDataFrame([(1, 7, "T1", None), (2, 8, None, None)], "rowid long, ID int, `Transect ID` string, `My Col` string")
    out = I.ingest(df, I.SPECS["seagrass"], "a/b.xlsx")
    assert out.columns == ["rowid", "transect", "my_col", "input_filename"] and out.count() == 1
    ids = spark.createDataFrame([("Fish a", 9)], "scientific_name string, taxonomic_id long")
    classes = spark.createDataFrame([(9, "species", "Chordata")], "taxonomic_id long, level string, phylum string")
    reef = sheet(spark, [("1", 3.0, "s", "p")]).withColumns({"Block": F.lit("x"), "Species": F.lit("Fish a"), "Z": F.lit(1)})
    out = I.ingest(reef, I.SPECS["reef-survey"], "f.xlsx", ids=ids, classes=classes)
    row = out.first()
    assert (row["method"], row["block"], row["phylum"], row["taxonomic_id"]) == (1.0, None, "Chordata", 9)
    assert out.columns.index("taxonomic_id") == out.columns.index("species") + 1
    with pytest.warns(UserWarning):
        assert I.warn_if_all_zero(sheet(spark, [("1", 0.0, "s", "p")]))


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b")], "n int, t string")
    assert sorted(tuple(r) for r in M.column_profile(df).collect()) == [("n", "int", 3, 0, 2), ("t", "string", 2, 1, 3)]
    assert [tuple(r) for r in M.column_minmax(df, ["n"]).collect()] == [("n", 1.0, 2.0, 0)]
    assert sorted(tuple(r)[::3] for r in M.conformance(df, [("n", "int"), ("t", "date"), ("z", "int")]).collect()) == [("n", "ok"), ("t", "type differs"), ("z", "missing")]
    runs = M.runs(df.withColumns({"k": F.lit(1)}), F.col("n") == 1, "t", ["k"])
    assert sorted((r["value"], r["run_length"]) for r in runs.collect()) == [(False, 1), (True, 2)]


def test_generated_conditions(spark):
    cells = {1: {"a": "x", "b": 1}, 2: {"a": "y", "b": 1}, 3: {"a": None, "b": 2}}
    df = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), (None, 2)], "a string, b int")
    condition, text = W.cells_filter(cells, [(1, "a"), (2, "a"), (1, "b")])
    assert text == "`a` IN ('x', 'y') AND `b` = 1"
    assert df.where(condition).count() == df.where(text).count() == 2
    column, text = W.cells_case_when(cells, [(1, "a"), (2, "a"), (1, "b")], {"x": "X"})
    assert [r[0] for r in df.select(column).collect()] == [r[0] for r in df.selectExpr(text).collect()] == ["X", "", "y", None]
    column, text = W.x_for_all_y(df, "a", ["b"], {(None, 2): "none", ("y", 2): "two"})
    assert [r[0] for r in df.select(column).collect()] == [r[0] for r in df.selectExpr(text).collect()] == ["x", "y", "two", "none"]

    @W.transform("double")
    def double(frame):
        return frame.withColumn("b", F.col("b") * 2)

    assert [r["b"] for r in W.apply(df, "double", "double").collect()] == [4, 4, 8, 8]
    with pytest.raises(ValueError, match="nothing"):
        W.apply(df, "nothing")
    compile(W.template("reef", ["a", "2.5"]), "script", "exec")


def test_load_by_table_id(spark):
    df = spark.createDataFrame([(1, "Y", "a note")], "rowid long, `Water Present Y N` string, `Site Notes (including recent perturbations and weather conditions)` string")
    out = I.load(df, "oyster-2025-reef-metadata-deployment", "/x/d.xlsx")
    assert out.columns == ["rowid", "water_present", "notes", "input_filename"] and out.first()["input_filename"] == "d.xlsx"
    with pytest.warns(UserWarning, match="no rows"):
        I.load(df.where("false"), "oyster-2025-rugosity", "d.xlsx")
    with pytest.raises(ValueError, match="no such table"):
        I.load(df, "other", "d.xlsx")
    with pytest.raises(ValueError, match="taxonomy"):
        I.load(spark.createDataFrame([(1, 1.0, "1", "s", "p", "0", "x")], "rowid long, Total double, Method string, `Site No.` string, `P-Qs` string, Block string, Species string"), "reef-life-survey-data-v1", "d.xlsx")


def test_combinations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), ("b", None)], "x string, y int")
    assert W.combinations(df, "x", ["y"]) == [(None, 1), ("a", 1), ("a", 2), ("b", None)]
    assert W.combinations(df, "x", ["y"], ["a", None]) == [(None, 1), ("a", 1), ("a", 2)]
    column, text = W.x_for_values(df, "x", ["y"], {"a": "A", None: "none"})
    assert [r[0] for r in df.select(column).collect()] == ["A", "A", "A", "none", "b"] and text.count("WHEN") == 3
    many = spark.range(W.MOST_BRANCHES + 1)
    with pytest.raises(ValueError, match="more than"):
        W.combinations(many, "id", [])


def test_registered_transforms(spark):
    df = spark.createDataFrame([("S1", "2024-01-02", 3.0), (None, None, 4.5)], "site_code string, date string, depth double")
    assert [r["sample_event_id"] for r in W.apply(df, "event_id").collect()] == ["S1_RLS_2024-01-02_3", "NA_RLS_NA_4.5"]
    df = spark.createDataFrame([("e", "5", "N", None, "1"), ("e", "BLANK", None, "10:00", None)], "sample_event_id string, vis string, direction string, time string, photoquadrats string")
    assert {r["vis"] for r in W.apply(df, "fill_metadata").collect()} == {"5"}


def test_steps_are_counted_by_the_job_itself(spark, tmp_path):
    rows = [(1, "1", 5.0), (2, "0, 1, 2", 0.0), (3, None, 3.0), (4, "2", 7.0), (5, "1", 0.0), (6, "1", 0.0)]
    sheet = spark.createDataFrame([(*r, "S", "p") for r in rows], "rowid long, Method string, Total double, `Site No.` string, `P-Qs` string")
    steps = I.Steps()
    out = I.ingest(sheet, I.SPECS["reef-survey-plain"], "a.xlsx", steps=steps)
    assert sorted(r["rowid"] for r in out.collect()) == [1, 4]
    assert steps.removed() == [("header_rows", 2), ("trailing_zeros", 2)]
    seagrass = spark.createDataFrame([(1, 7, "T1"), (2, 8, None)], "rowid long, ID int, `Transect ID` string")
    assert I.load_counted(seagrass, "shoot-count-monitoring-v1", "s.xlsx", str(tmp_path / "t")) == [("empty_rows", 1)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert I.removed_rows(sheet, out) == 4


def test_profile_by_a_sketch(spark):
    df = spark.createDataFrame([(i % 50, None if i % 3 else float(i % 7), 0.0 if i % 2 else -0.0) for i in range(600)], "a int, b double, z double")
    exact, rough = ({r["column_name"]: tuple(r)[2:] for r in M.column_profile(df, exact=e).collect()} for e in (True, False))
    assert exact == {"a": (600, 0, 50), "b": (200, 400, 8), "z": (600, 0, 1)}
    assert all(abs(exact[c][2] - rough[c][2]) <= 0.1 * exact[c][2] + 1 and exact[c][:2] == rough[c][:2] for c in exact)
    assert M.column_profile(df)._jdf.queryExecution().executedPlan().toString().count("Expand") == 0
    assert {r["column_name"]: r["n_failing"] for r in M.conformance(df, [("a", "string"), ("b", "int"), ("q", "int")]).collect()} == {"a": 0, "b": 0, "q": None, "z": None}


def test_orders_of_results(spark, sf):
    """Ids ascend and unknown names come last; events ascend by the bytes of their id. Both over whole tables."""
    ids = [r["taxonomic_id"] for r in QUERIES["tax_right_join"](spark, sf).collect()]
    known = [x for x in ids if x is not None]
    assert 0 < len(known) < len(ids) and ids == sorted(known) + [None] * (len(ids) - len(known))
    events = [r["sample_event_id"].encode() for r in QUERIES["event_summary"](spark, sf).collect()]
    assert len(events) > 10 and events == sorted(events)


def test_order_of_ids_that_are_not_ascii(spark):
    rows = [(site, "2020-01-01", 5.0, 1, 1) for site in ("é", "z", "A", "a", "_", "Z", "漢", None, "\U0001f41f")]
    out = E.event_summary(spark.createDataFrame(rows, "site_code string, date string, depth double, method int, block int"))
    events = [r["sample_event_id"].encode() for r in out.collect()]
    assert len(events) == len(rows) and events == sorted(events)
