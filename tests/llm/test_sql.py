"""Queries with SQL give the same rows in Spark and DuckDB."""

import duckdb
import pytest

from rulewright.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    by = lambda rows: sorted(rows, key=str)
    assert by(tuple(r[c] for c in names) for r in got.collect()) == by(want.fetchall())
