"""Every query with SQL gives DuckDB's rows; the registered names agree."""

import decimal
import math

import duckdb
import pytest

from parley.plans.oracle import ORACLE
from parley.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else ("f", round(float(v), 6))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 45


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    there = [c[0] for c in result.description]
    assert sorted(there) == columns
    expected = sorted(repr(tuple(plain(r[there.index(c)]) for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == expected
