"""Every query of the subpackage with SQL gives DuckDB's rows."""

import duckdb
import pytest

from parley.llm import queries


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name, at):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    df = queries.queries()[name](spark, at)
    columns = sorted(df.columns)
    result = duck.execute(queries.oracle_sql()[name])
    there = [c[0] for c in result.description]
    assert sorted(there) == columns
    expected = sorted(repr(tuple(r[there.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in result.description}


def test_names():
    assert len([n for n in queries.queries() if n.startswith("op")]) == 10
