"""Every query with SQL against DuckDB, on the smallest tables."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SQL = {n: q for n, q in entry.oracle_sql().items() if n in entry.queries()}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, (datetime, date)):
        return str(v)
    return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["table_name", "period", "orphan_kind", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
