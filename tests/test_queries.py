"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
OWN = entry._own.QUERIES


def rows_of(values):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values], key=repr)


@pytest.mark.parametrize("name", list(OWN))
def test_query(spark, name):
    df = OWN[name](spark, DIR)
    names = sorted(df.columns)
    got = rows_of(df.select(*names).collect())
    if name not in entry._own.SQL:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    want = con.sql(entry._own.SQL[name])
    assert sorted(want.columns) == names
    assert got == rows_of(con.sql(f"select {', '.join(names)} from want").fetchall())


def test_near_pairs_of_equal_hashes(spark, tmp_path):
    """Copies are pairs at distance 0, also of many rows; rows of one ord are none."""
    con = duckdb.connect()
    con.sql(f"create table base as select * from '{DIR}/embeddings.parquet' where vec_id < 60")
    con.sql("create table embeddings as select * from base union all select vec_id + 100, embedding, label from base where vec_id < 5 union all select vec_id + 200, embedding, label from base where vec_id = 3")
    con.sql("insert into embeddings select vec_id + 1, embedding, label from base where vec_id in (8, 20)")
    con.sql(f"copy embeddings to '{tmp_path}/embeddings.parquet'")
    got = rows_of(OWN["d0_near_pairs"](spark, str(tmp_path)).select("a_ord", "b_ord", "distance").collect())
    assert got == rows_of(con.sql(f"select a_ord, b_ord, distance from ({entry._own.SQL['d0_near_pairs']})").fetchall())
    assert {(3, 103, 0), (3, 203, 0), (103, 203, 0), (8, 9, 0)} <= set(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 500
