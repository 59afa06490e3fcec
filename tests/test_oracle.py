"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lectern.plans.catalogue import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(canon(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
