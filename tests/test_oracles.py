"""Every registered query against its SQL on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert got == want


def test_entry_has_stable_schema(spark):
    assert entry_points.entry(spark).columns == ["query_id", "kind", "uuid", "score", "rank"]
