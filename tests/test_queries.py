"""All registered queries on the smallest tables against their oracle texts."""
import duckdb
import pytest

from roadrisk.plans.bindings import BASE_TABLES
from roadrisk.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES)


def canon(v):
    return "~" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    want = sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
