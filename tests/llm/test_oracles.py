"""Queries with SQL of their own give the same rows as another engine."""

import glob
import os

import duckdb
import pytest

from modeflow.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, other = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.sql(f"SELECT {', '.join(sorted(other.columns))} FROM ({ORACLE_SQL[name]})").fetchall())
