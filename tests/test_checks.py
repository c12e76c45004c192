"""Registered queries against their SQL at the smallest scale.

A sample by default; ``ALL_CHECKS=1`` runs every one.
"""

import os

import duckdb
import pytest

import tradeweft.checks as checks

NAMES = checks.names()
SAMPLE = [n for i, n in enumerate(NAMES) if i % 6 == 0 and not n.startswith(("m11", "m12"))]


@pytest.fixture(scope="module")
def con(tables):
    db = duckdb.connect()
    for f in sorted(os.listdir(tables)):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tables}/{f}'")
    return db


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES if os.environ.get("ALL_CHECKS") else SAMPLE)
def test_query_equals_sql(spark, con, tables, name):
    df = checks.run(name, spark, tables)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    sql = checks.oracle(name)
    if sql is None:
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(row[i]) for i in at) for row in res.fetchall())


def test_every_query_is_registered_once():
    assert len(NAMES) == len(set(NAMES)) > 150
