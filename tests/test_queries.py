"""Every query against its SQL, and the driver's contract."""

import duckdb
import pytest
from depthbook.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return -1e300 if isinstance(v, float) and v != v else v  # NaN is no value to sort by


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, sql, name):
    df = QUERIES[name](spark, small)
    got = sorted(tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    rel = sql.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
