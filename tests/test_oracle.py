"""Every query with SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

from tabbyline.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in found), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    result = sql.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark).collect()
    assert len(first) == 5 and first[0]["vec_id"] == 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
