"""Every query of the catalogue against its DuckDB twin on the smallest dataset."""

import datetime
import decimal
import math

import duckdb
import pytest

from lattica.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.6g}")
    if isinstance(v, int):
        return v
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        twin = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(twin.columns)
        assert found == rows(twin.columns, twin.fetchall())
    else:
        assert found
