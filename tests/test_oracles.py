"""Every registered query of the engine's own operators against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from quern.plans import audits, evaluation, ingest, operations, questions, retrieval, selection

SF = "/root/testdata/sf0.001"
PLANS = (audits, retrieval, evaluation, ingest, operations, selection, questions)
QUERIES = {k: f for p in PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PLANS for k, s in p.SQL.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def _rows(rows):
    return Counter(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _rows(df.select(*cols).collect()) == _rows([tuple(r[i] for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names_are_distinct():
    assert len(QUERIES) == sum(len(p.QUERIES) for p in PLANS) and set(SQL) <= set(QUERIES)
