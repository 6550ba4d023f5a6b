"""Every core query with SQL gives DuckDB's result; the others give rows with a stable schema."""

import pytest
from compare import compare

from textstrata import catalogue
from textstrata.plans.golden import CASES_OF

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    said = compare(spark, sf, name, QUERIES[name], SQL[name])
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(CASES_OF))
def test_known_cases(spark, sf, name):
    query, sql = CASES_OF[name]
    said = compare(spark, sf, name, query, sql)
    assert said.startswith("ok"), said


def test_known_cases_have_queries_over_tables():
    assert set(CASES_OF) <= set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_llm(spark):
    """The entry module imports and offers the core queries, whatever else is there."""
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
