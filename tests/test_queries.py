"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__
from spoor.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr) == got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
