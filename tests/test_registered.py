"""Every registered query beside its SQL at the smallest scale."""

import duckdb
import pytest

from checks.compare import TABLES, _table
from checks.oracle import ORACLE
from checks.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, ROOT)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        cursor = db.execute(ORACLE[name])
        assert got == _table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 6000
    assert set(contract.oracle_sql()) <= set(contract.queries())
