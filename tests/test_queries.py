"""Every query that has SQL gives the rows that DuckDB gives for it on the same tables."""

import math

import duckdb
import pytest

from attesta.plans.catalog import ORACLE_SQL, QUERIES
from attesta.session import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    found = tables.execute(ORACLE_SQL[name])
    expected = ordered([c[0] for c in found.description], found.fetchall())
    assert ordered(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows_and_repeats(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    first, again = (ordered(df.columns, QUERIES[name](spark, SF_DIR).collect()) for _ in range(2))
    assert first == again and first[1]
