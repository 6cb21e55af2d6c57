"""Every registered catalog query against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

from larder import catalog_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog_queries.queries()[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    sql = catalog_queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    want = rows_of(result.fetchall(), result.columns)
    assert len(got) == len(want)
    assert got == want
