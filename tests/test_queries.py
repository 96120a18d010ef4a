"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract

DATA = contract.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    df = contract.queries()[name](spark, DATA)
    cursor = engine.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = ordered(names, cursor.fetchall())
    assert expected
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    assert got == expected


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["loan_id", "Customer_ID", "label", "label_def", "snapshot_date"]
    assert df.count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
