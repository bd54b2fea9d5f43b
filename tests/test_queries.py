"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from scorefield.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    try:
        return f"{float(x):.9g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", ["scorefield.llm.queries", "corpus_pipeline"])
def test_the_other_queries_stay_where_a_part_cannot_be_imported(monkeypatch, gone):
    import sys

    import __spark_entry__ as e

    whole = set(e.queries())
    monkeypatch.setitem(sys.modules, gone, None)
    left = set(e.queries())
    assert set(QUERIES) <= left <= whole and "pipeline" not in left
    assert set(e.oracle_sql()) <= left
