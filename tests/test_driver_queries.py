"""Every query with SQL gives DuckDB's rows on the same files."""

import os

import duckdb
import pytest

from millrace.plans import driver

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" if os.path.isfile(f"{DATA}/{f}") else f"{DATA}/{f}/*.parquet"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def canonical(rows):
    return sorted(tuple("nan" if v != v else float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.ORACLES))
def test_matches_sql(spark, duck, name):
    df = driver.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"select {','.join(chr(34) + c + chr(34) for c in cols)} from ({driver.ORACLES[name]})").fetchall()
    assert canonical(df.select(*cols).collect()) == canonical(want)
