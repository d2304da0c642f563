"""Every query that SQL expresses gives the rows that DuckDB gives for its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from granary.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM read_parquet('{p}')")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
