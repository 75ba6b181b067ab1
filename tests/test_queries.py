"""Every registered relational query against its SQL on the smallest tables."""

import duckdb
import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in df.columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def test_queries_without_sql_have_rows(spark):
    for name in registry.QUERIES.keys() - registry.ORACLE_SQL.keys():
        assert not registry.QUERIES[name](spark, SF).isEmpty(), name


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
