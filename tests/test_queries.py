"""Every query that SQL can express against DuckDB; the rest must run with stable columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries
from leafmill import catalog


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(con.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entries.entry(spark).count() == 200
    assert set(catalog.QUERIES) <= set(entries.queries()) and set(entries.oracle_sql()) <= set(entries.queries())
