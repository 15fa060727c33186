"""A task's text is parsed once, whatever the number of rules that read it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trajlake.operators import validate
from trajlake.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan_of(spark, df) -> str:
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_task_check_parses_a_task_once(spark):
    assert plan_of(spark, catalog.QUERIES["task_structure_score"](spark, DATA)).count("parseJson") == 1


def test_task_check_of_odd_tasks(spark):
    instructions = {"domain": "d", "reason_for_call": "r" * 25, "known_info": "", "task_instructions": "t" * 40}
    fine = {"id": "1", "description": {}, "user_scenario": {"persona": "p", "instructions": instructions}, "evaluation_criteria": {"actions": [{"name": "a", "arguments": {}}], "nl_assertions": ["x"]}}
    cases = [
        (json.dumps(fine), (True, 1.0, [], [])),
        (json.dumps(fine | {"id": 3, "description": None}), (False, 0.8, ["Field id should be string", "Field description should be object"], [])),
        (json.dumps(fine | {"user_scenario": {"persona": 1, "instructions": []}}), (False, 0.4, ["user_scenario.persona should be string", "user_scenario.instructions should be object", *[f"Missing instructions.{k}" for k in instructions]], ["reason_for_call too short", "task_instructions too short"])),
        (json.dumps(fine | {"evaluation_criteria": {"actions": ["x", None, {"name": "a"}, {"arguments": 1}]}}), (False, 0.68, ["Missing evaluation_criteria.nl_assertions", "2 actions are no objects", "1 actions without name"], ["nl_assertions is empty", "1 actions without arguments"])),
        ("no json", (False, 0.0, [f"Missing required field: {k}" for k in fine], [])),
        (json.dumps(fine) + "{}", (False, 0.0, [f"Missing required field: {k}" for k in fine], [])),
        (None, (False, 0.0, [f"Missing required field: {k}" for k in fine], [])),
    ]
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string").select("k", validate.task_check(F.col("c")).alias("v"))
    got = {r["k"]: (r["v"]["valid"], r["v"]["score"], list(r["v"]["errors"]), list(r["v"]["warnings"])) for r in rows.collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
