"""The driver contract: every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cuelark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = sql.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    other = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert rows == other


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["video_id", "ord", "line"] and entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalogue.QUERIES) <= set(queries)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_plans_use_one_order(spark):
    """Frame operators of a plan share their exchange by video: no more exchanges than a plan with one operator, and one for each other key."""
    from cuelark.operators import frames as fr
    from cuelark.sources.tables import event_frames

    rows = event_frames(spark, DATA)
    one = fr.feature_jump(rows, "feat", "a")
    two = fr.shift(fr.feature_jump(one, "feat", "b", window=5), "c", "feat", 1, 0.0)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(two) == count(one)
