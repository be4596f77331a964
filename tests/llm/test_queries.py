"""The queries over the smallest tables: SQL where there is some, stated columns for all."""

import os

import duckdb
import pytest

from tabbyline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id"], "p2_found": ["id"], "p3_found": ["id", "line_no"], "p4_found": ["id"], "p5_found": ["id_a", "id_b"], "p6_found": ["id"], "p7_found": ["id", "line_no"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id"], "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    assert sorted(map(tuple, QUERIES[name](spark, DATA).collect())) == sorted(con.execute(ORACLE_SQL[name]).fetchall())
