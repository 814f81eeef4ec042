"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import os

import duckdb
import pytest

from logloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tiny, duck, name):
    found = QUERIES[name](spark, tiny)
    columns = sorted(found.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(repr([plain(dict(zip(theirs, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark, tiny):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
