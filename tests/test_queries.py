"""Every query against its SQL in DuckDB, on the same tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from fieldsieve.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_without_corpus_operators(tmp_path):
    """The library stands without the corpus subpackage and the pipeline."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['fieldsieve.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True)
