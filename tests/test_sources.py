import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from fieldsieve.operators import ingest
from fieldsieve.sources import excel, files, resolver, tables, workbooks
from fieldsieve.sources.catalog import Catalog, CatalogTables

STRUCTURE = "﻿protocol,table_id,level,column_name,data_type\nP,t-v1,2,site,STRING\nP,t-v1,2,2.5,INT\nP,t-v1,2,block,TINYINT\nP,t-v1,2,date,DATE\nP,t-v1,2,clock,TIME\nP,t-v1,2,timestamp_utc,STRING\nP,t-v1,2,depth,DOUBLE\nP,u-v1,2,x,INT64\n"
INDEX = "protocol,level,table_name,table_id,directory,script_directory,location\nP,2,T,t-v1,data/t-v1,,github\nP,2,V,v-v1,,,\n"
RELATIONS = "﻿table_id_in,table_id_out,notes\nin,t-v1,\nin,w-v1,\n"


@pytest.fixture()
def catalog(tmp_path):
    for name, text in (("s.csv", STRUCTURE), ("i.csv", INDEX), ("r.csv", RELATIONS)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    return Catalog((str(tmp_path / "i.csv"),), (str(tmp_path / "r.csv"),), (str(tmp_path / "s.csv"),))


def test_catalog(spark, catalog, tmp_path, monkeypatch):
    assert [f.dataType.simpleString() for f in catalog.schema("t-v1")] == ["string", "int", "smallint", "date", "string", "timestamp", "double"]
    assert catalog.column_order("t-v1")[1] == "2.5" and catalog.outputs_of("in") == ["t-v1", "w-v1"]
    assert catalog.gaps() == {"not_in_index": ["u-v1"], "without_structure": ["w-v1"]}
    assert catalog.frame(spark, "structure").count() == 8
    for bad, what in (("nope", "no table"), ("v-v1", "not stored")):
        with pytest.raises(ValueError, match=what):
            catalog.path(bad, "/r")
    monkeypatch.delenv("FIELD_DATA_ROOT", raising=False)
    with pytest.raises(ValueError, match="FIELD_DATA_ROOT"):
        catalog.path("t-v1")
    folder = tmp_path / "data/t-v1"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text('anything,goes,here,d,e,f,g\nS,5,200,2024-01-02,10:00:00,2024-01-02 03:04:05,1.5\nNA,x,"",NA,,,NA\n')
    (folder / "b.csv").write_text("h,h,h,h,h,h,h\nZ,1,1,2024-01-03,,,2\n")
    rows = {r["site"]: r for r in catalog.scan(spark, "t-v1", str(tmp_path)).collect()}
    assert set(rows) == {"S", None, "Z"} and rows["S"]["block"] == 200 and rows["S"]["2.5"] == 5
    assert all(v is None for v in rows[None])


def test_catalog_tables(spark, catalog, tmp_path):
    """Kept in a folder and read back; derived tables through others, cycles included; gaps."""
    tables = CatalogTables.of(spark, catalog)
    tables.save(str(tmp_path / "kept"))
    back = CatalogTables.load(spark, str(tmp_path / "kept"))
    assert sorted(map(tuple, back.structure.collect())) == sorted(map(tuple, tables.structure.collect()))
    assert sorted(map(tuple, back.gaps().collect())) == [("u-v1", "not_in_index"), ("w-v1", "without_structure")]
    assert sorted(map(tuple, back.resolved().collect())) == [("in", "t-v1", 1, 7), ("in", "w-v1", 1, 0)]
    back.register("own_")
    assert spark.sql("SELECT count(*) AS n FROM own_structure WHERE table_id = 't-v1'").first()["n"] == 7
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c"), (None, "x"), ("x", None), ("a", "b")], "table_id_in string, table_id_out string")
    made = CatalogTables.described({"d": spark.range(1), "z": spark.range(1).selectExpr("id", "current_date() AS day")}, chain)
    found = {(r["table_id_in"], r["table_id_out"]): (r["steps"], r["n_columns"]) for r in made.resolved().collect()}
    assert found[("a", "d")] == (2, 1) and found[("a", "a")] == (2, 0) and found[("b", "b")] == (3, 0) and len(found) == 12
    assert sorted(tuple(r) for r in made.structure.where("table_id = 'z'").collect()) == [("z", "day", "DATE"), ("z", "id", "INT64")]
    with pytest.raises(RuntimeError, match="more than 2"):
        made.outputs(2)


def test_csv_out(spark, tmp_path):
    df = tables.literal(spark, [(1, "a")], "x int, y string")
    tables.write_csv(df, str(tmp_path / "o"), ["y", "x"])
    back = tables.read_inferred(spark, str(tmp_path / "o"))
    assert back.columns == ["y", "x"] and back.first()["x"] == 1
    with pytest.raises(ValueError, match="z"):
        tables.write_csv(df, str(tmp_path / "p"), ["z"])


def workbook(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, tuple):  # a date's serial number
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{k + 1}">' + "".join(cell(f"{chr(65 + j)}{k + 1}", v) for j, v in enumerate(r)) + "</row>" for k, r in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet {main}><dimension ref="A1:Z{len(rows)}"/>' + f"<sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    workbook(path, {"INFO": [["x"]], "DATA": [["Method", "Total", "Date", "Site No."], ["0, 1, 2", None, None, None], [1, 10, (45293,), "S1"], [None, None, None, None], [2, 0.5, (45294.5,), None]]})
    assert [r["sheet"] for r in excel.sheet_names(spark, path).collect()] == ["INFO", "DATA"]
    df = excel.read_sheet(spark, path, "DATA")
    assert dict(df.dtypes) == {"Method": "string", "Total": "double", "Date": "timestamp_ntz", "Site No.": "string", "rowid": "bigint"}
    got = [(r["Method"], r["Total"], str(r["Date"]), r["rowid"]) for r in df.orderBy("rowid").collect()]
    assert got == [("0, 1, 2", None, "None", 1), ("1", 10.0, "2024-01-02 00:00:00", 2), ("2", 0.5, "2024-01-03 12:00:00", 4)]
    schema = T.StructType([T.StructField("m", T.StringType()), T.StructField("t", T.DoubleType())])
    workbook(str(tmp_path / "b.xlsx"), {"DATA": [["Method", "Total"], [3, 7]]})
    assert sorted(r["t"] for r in excel.read_sheet(spark, str(tmp_path / "*.xlsx"), "DATA", schema).where("t is not null").collect()) == [0.5, 7.0, 10.0]
    with pytest.raises(ValueError, match="INFO, DATA"):
        excel.read_sheet(spark, path, "NONE")


def test_many_workbooks(spark, tmp_path):
    """Seventeen files in one read: headers in any order, types merged, rows by ranges, each with its own file."""
    for i in range(17):
        names = ["Method", "Total", "Site No.", "P-Qs", *["Extra"] * (i == 4)]
        names = names[i % 4 :] + names[: i % 4]
        row = lambda k: {"Method": "0, 1, 2" if k == 3 else k % 3, "Total": 0 if k > 7 + i % 2 else k + 1, "Site No.": f"S{i}" if i else i, "P-Qs": (45293 + k,), "Extra": k}  # noqa: B023, E731
        workbook(str(tmp_path / f"f{i:02d}.xlsx"), {"DATA": [names, *[[row(k)[n] for n in names] for k in range(12)]]})
    df = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx"), "DATA", rows=5)
    assert df.columns == ["Method", "Total", "Site No.", "P-Qs", "Extra", "rowid", "input_filename"]
    kinds = dict(df.dtypes)
    assert (kinds["Total"], kinds["Site No."], kinds["P-Qs"], kinds["Extra"]) == ("double", "string", "timestamp_ntz", "double")
    rows = df.orderBy("input_filename", "rowid").collect()
    assert [(r["input_filename"], r["rowid"]) for r in rows] == [(f"f{i:02d}.xlsx", k + 1) for i in range(17) for k in range(12)]
    assert all(r["Site No."] == ("0" if r["input_filename"] == "f00.xlsx" else f"S{int(r['input_filename'][1:3])}") for r in rows)
    assert {r["input_filename"] for r in rows if r["Extra"] is not None} == {"f04.xlsx"}
    assert df.rdd.getNumPartitions() == 17 * 3
    with pytest.raises(ValueError, match="one workbook"):
        excel.read_sheet(spark, str(tmp_path / "*.xlsx"), "DATA")
    out = ingest.ingest(df.drop("Extra"), ingest.SPECS["reef-survey-plain"], F.col("input_filename"))
    left = {r["input_filename"]: r["n"] for r in out.groupBy("input_filename").agg(F.count("*").alias("n")).collect()}
    assert left == {f"f{i:02d}.xlsx": 7 + i % 2 for i in range(17)}  # zeros at the end of each file are gone, and its repeated header
    seagrass = tmp_path / "s"
    seagrass.mkdir()
    for i in range(2):
        workbook(str(seagrass / f"s{i}.xlsx"), {"D": [["ID", "Transect ID", "Shoots Count"], [1, f"T{i}", 3], [2, None, None]]})
    loaded = workbooks.load_workbooks(spark, str(seagrass / "*.xlsx"), "shoot-count-monitoring-v1", "D")
    assert sorted((r["transect"], r["input_filename"]) for r in loaded.collect()) == [("T0", "s0.xlsx"), ("T1", "s1.xlsx")]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_workbooks(spark, str(seagrass / "*.xlsx"), "NONE")


def test_files(spark, tmp_path):
    (tmp_path / "p1/x").mkdir(parents=True)
    (tmp_path / "p1/x/a.R").write_text("\n".join(map(str, range(15))))
    (tmp_path / "b.txt").write_text("q")
    found = {r["file_name"]: r["project"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert found == {"a.R": "p1", "b.txt": None}
    assert files.existing(spark, [str(tmp_path), str(tmp_path / "none")]) == [str(tmp_path)]
    assert files.preview(spark, str(tmp_path / "p1/x/a.R")) == ([str(i) for i in range(10)], 5)
    assert files.excerpt(["a", "# Start", "b", "c", "# End", "d"], "# Start", "# End") == ["b", "c"]
    files.write_text(str(tmp_path / "c.txt"), "é")
    assert (tmp_path / "c.txt").read_text(encoding="utf-8") == "é"


def test_resolver(spark):
    from fieldsieve.operators.joins import resolve_names

    known = {"Mollusca": "51", "Lithothamnion": "144018", "Gone": "-999", "Odd": "Not found"}
    names = spark.createDataFrame([("Mollusca sp.",), ("Lithothamnion",), ("Gone",), ("Odd",), ("Never",)], "scientific_name string")
    asked = spark.createDataFrame([(n,) for n in [*known, "Never"]], "scientific_name string")
    table = resolver.lookup(asked, lambda batch: {n: known[n] for n in batch if n in known})
    got = [tuple(r) for r in resolve_names(names, table).collect()]
    assert got[:2] == [("Mollusca", 51, "Mollusca sp."), ("Lithothamnion", 144018, "Lithothamnion")]
    assert len(got) == 5 and all(r[1] is None for r in got[2:])
    ranks = resolver.ranks(spark.createDataFrame([(51,)], "taxonomic_id long"), lambda i: [("Kingdom", "Animalia"), ("Phylum", "Mollusca")])
    assert [tuple(r) for r in ranks.collect()] == [("51", 0, "Kingdom", "Animalia"), ("51", 1, "Phylum", "Mollusca")]


def test_answers_are_kept(spark, tmp_path):
    """A client that fails at times: a name is asked for until it is answered, and never again."""
    log, kept = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()

    def client(batch):
        for n in batch:
            with open(log / n, "a") as f:
                f.write("x")
        if "bad" in batch and len((log / "bad").read_text()) < 5:
            raise OSError("service is down")
        return {n: f"id-{n}" for n in batch if n != "none"}

    names = spark.createDataFrame([(n,) for n in ("a", "b", "bad", "none", "a", None)], "scientific_name string")
    with pytest.raises(RuntimeError, match="1 names could not be looked up"):
        resolver.lookup_kept(names, client, kept, batch=1)
    assert {p.name: len(p.read_text()) for p in log.iterdir()} == {"a": 1, "b": 1, "none": 1, "bad": 3}
    got = resolver.lookup_kept(names, client, kept, batch=1)
    assert sorted(map(tuple, got.collect())) == [("a", "id-a"), ("b", "id-b"), ("bad", "id-bad")]
    assert {p.name: len(p.read_text()) for p in log.iterdir()} == {"a": 1, "b": 1, "none": 1, "bad": 5}
    more = spark.createDataFrame([("b",), ("c",)], "scientific_name string")
    assert sorted(map(tuple, resolver.lookup_kept(more, client, kept).collect())) == [("b", "id-b"), ("c", "id-c")]
    assert len((log / "b").read_text()) == 1
