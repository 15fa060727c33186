"""What operators leave in the shared folder: the tables that their results read, and nothing at the end of the process."""

import os
import subprocess
import sys

import pytest

from trajlake.llm import common, queries

DATA = "/root/testdata/sf0.001"


def tables(spark):
    folder = common._folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "most"), [("op1_near_dedup", 2), ("op5_embedding_dedup", 1), ("op11_vector_codes", 2), ("op12_prefix_trie", 1), ("op13_toxicity", 0), ("op10_quality_classifier", 1)])
def test_only_what_the_result_reads_stays(spark, name, most):
    before = tables(spark)
    assert queries.QUERIES[name](spark, DATA).count()
    assert len(tables(spark) - before) <= most


@pytest.mark.parametrize("stop", [True, False])
def test_the_folder_goes_with_the_process(tmp_path, stop):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from trajlake.llm.common import materialize
from trajlake.storage import written
materialize(spark.range(3)); written(spark.range(3))
import os
assert sum(n.startswith("trajlake") for n in os.listdir({str(tmp_path)!r})) == 2
{"spark.stop()" if stop else ""}
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), capture_output=True, timeout=300)
    assert [n for n in os.listdir(tmp_path) if n.startswith("trajlake")] == []
