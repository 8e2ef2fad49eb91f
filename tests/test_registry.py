"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from leafvoice.registry import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    key = lambda row: [(v is None, str(v)) for v in row]
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == want
