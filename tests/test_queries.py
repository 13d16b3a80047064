"""Every query: the shape of its plan, and its result against its SQL, on the smallest tables."""

import re

import duckdb
import pytest
from conftest import SF

from turnmill.plans import registry

registry.load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# A window without keys is allowed on a table of bucket totals, of different counts, of special tokens, of folder or of file names.
BOUNDED_ORDER = ("_bucket", "pos", "top", "path", "_times")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in at) for r in rows)


def check_plan(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert banned not in plan, f"{banned} in {name}"
    for line in plan.splitlines():
        if "Window [" in line and re.search(r"\], \[[a-z_#0-9L]+ (ASC|DESC)", line) and line.rstrip().count("], [") == 1:
            assert any(k in line for k in BOUNDED_ORDER), line


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    check_plan(df, name)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    assert name in registry.ORACLES
    res = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == ordered(res.fetchall(), cols)
