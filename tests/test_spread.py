"""Costly steps on short rows: a small file's rows are dealt over all tasks."""

import pytest
from pyspark.sql import functions as F

from textstrata.catalogue import queries
from textstrata.plans.base import spread, table


@pytest.mark.parametrize("name", ["structure_chunks", "structure_outline", "redact_identifiers", "citations_extract"])
def test_rows_of_one_file_are_parsed_by_many_tasks(spark, sf, name):
    got = queries()[name](spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) >= 4 and max(r["count"] for r in got) < 0.5 * sum(r["count"] for r in got)


def test_names_are_searched_by_many_tasks(spark, sf):
    plan = queries()["word_search_names"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Repartition" in plan.split("MapInArrow")[1]


def test_spread_keeps_all_rows(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name")
    assert sorted(spread(names).collect()) == sorted(names.collect())
