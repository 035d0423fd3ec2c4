"""Every registered query with a SQL twin must agree with DuckDB on the small fixture
(columns, row count and values rounded to 6 digits, order-free)."""
import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 130


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, con, name):
    sdf = QUERIES[name](spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)
