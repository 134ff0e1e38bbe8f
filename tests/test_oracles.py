"""Every query with SQL gives DuckDB's rows at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from spindrift.plans.all import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "quantize"):
        return float(v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    assert got == want
    assert want or name in {"set_repeat_n"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
