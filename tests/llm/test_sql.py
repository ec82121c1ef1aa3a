"""Queries of the operators that have SQL give the rows that DuckDB gives for it."""

import glob
import os
from collections import Counter

import pytest

from ledgerlens.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    mine = QUERIES[name](spark, DATA)
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(mine.columns) == sorted(names)
    order = [names.index(c) for c in mine.columns]
    assert Counter(tuple(r) for r in mine.collect()) == Counter(tuple(r[i] for i in order) for r in result.fetchall())
