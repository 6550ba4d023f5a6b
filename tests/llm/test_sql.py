"""Operators that SQL can express, against DuckDB at sf0.001."""

import pytest
from compare import compare

from textstrata.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    said = compare(spark, sf, name, registry.queries()[name], SQL[name])
    assert said.startswith("ok"), said
