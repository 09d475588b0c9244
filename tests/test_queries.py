"""Every registered query with SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pytest

from logtide.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [list(want.columns).index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
