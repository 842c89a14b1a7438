"""Every registered query of the reference operators against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from hushframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, sql, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)


def test_the_rest_is_held_against_python():
    """Queries without SQL: tests/test_brute.py has them all."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"candidate_top14", "blind_documents", "eval_suite", "eval_suite_fixture_off", "corpus_cases"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
