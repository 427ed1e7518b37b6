"""Every bound query with an oracle against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from factweave.plans import bindings, documents, facts, flows, impacts, traces  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF)
    cur = duck.execute(bindings.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
