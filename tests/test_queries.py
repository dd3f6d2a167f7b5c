"""Every registered query against its SQL, as the driver compares them."""

import math

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if type(value).__name__ == "Decimal":
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cursor = oracle.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: [(x is not None, str(x)) for x in row]
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    want = sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=key)
    assert got == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1
