"""Every query with SQL gives the same rows in Spark and DuckDB."""

import os

import duckdb
import pytest

from rulewright.plans import queries as plans
from rulewright.plans import lookups, records, verification  # noqa: F401  (add their queries to the same registry)

DATA = os.environ.get("RULEWRIGHT_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.execute(plans.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r[c] for c in sorted(names)) for r in got.collect()) == plain(tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())


def test_token_bucket(spark):
    rows = plans.QUERIES["token_bucket_decisions"](spark, DATA)
    events = {r.event_id: r for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    got = {r.event_id: r.allowed for r in rows.collect()}
    assert set(got) == set(events)
    state = {}
    for e in sorted(events.values(), key=lambda e: (e.user_id, e.ts, e.event_id)):
        tokens, last = state.get(e.user_id, (10.0, e.ts))
        tokens = min(10.0, tokens + (e.ts - last).total_seconds() / 6)
        assert got[e.event_id] == (tokens >= 1 - 1e-9) or abs(tokens - 1) < 1e-6
        state[e.user_id] = (tokens - got[e.event_id], e.ts)


def test_entry_registers_everything(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
