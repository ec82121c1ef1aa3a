"""Every query with SQL gives the rows that DuckDB gives for it."""

import glob
import os
from collections import Counter

import pytest

from ledgerlens.plans import catalogue, workflow  # noqa: F401  the second registers its queries with the first

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, db, name):
    mine = catalogue.QUERIES[name](spark, DATA)
    result = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(names, result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
