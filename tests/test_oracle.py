"""Every core query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from leafmill import catalog  # noqa: E402

DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, str):
        return v
    try:
        return str(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_needs_no_training_data_package(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "leafmill.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as e

    assert set(e.queries()) == set(catalog.queries()) and e.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__")
