"""Texts are parsed a few times a row, whatever the number of rules that read them, and small tables go to the rows."""

import os

import pytest

from trajlake.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan_of(spark, df) -> str:
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_fault_recoveries_stay_where_they_are_and_parse_little(spark):
    plan = plan_of(spark, catalog.QUERIES["fault_recoveries"](spark, DATA))
    assert plan.count("parseJson") < 60  # 250 before
    assert "SortMergeJoin" not in plan  # by the tool, of which there are few
