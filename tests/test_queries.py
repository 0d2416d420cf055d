"""Every query that has SQL gives the same rows in both engines, over the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest
from terraloom.plans.queries import FLAGSHIP, QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(([value(r[c]) for c in columns] for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = sorted(([value(r[names.index(c)]) for c in columns] for r in cur.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
