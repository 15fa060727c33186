"""Queries whose result once was made smaller: a row for every document, and whole groups."""

import os

import pytest
from pyspark.sql import functions as F

from trajlake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_reply_rules_judge_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = catalog.QUERIES["user_reply_rules"](spark, DATA)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert out.where(~F.col("too_long").eqNullSafe(F.col("many_sentences") | F.col("long"))).collect() == []


def test_responses_of_a_task_are_one_whole_list(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want: dict = {}
    for r in docs.select("lang", "doc_id", "source").collect():
        want.setdefault((r["lang"], r["doc_id"] % 50), []).append((r["source"], r["doc_id"]))
    out = catalog.QUERIES["cogroup_responses"](spark, DATA).collect()
    assert len(out) == len(want)
    for r in out:
        mine = sorted(want[r["domain"], r["task"]])
        assert r["responses"] == ",".join(f"{s}:{k}" for s, k in mine) and r["n_models"] == len({s for s, _ in mine})


def test_responses_without_a_model_are_left_out_as_in_sql(spark, tmp_path):
    rows = [("en", 1, "a"), ("en", 51, "b"), ("en", 101, None), ("en", 151, "a"), ("fr", 1, None)]
    spark.createDataFrame(rows, "lang string, doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["domain"]: (r["n_models"], r["responses"]) for r in catalog.QUERIES["cogroup_responses"](spark, str(tmp_path)).collect()}
    assert out == {"en": (2, "a:1,a:151,b:51"), "fr": (0, None)}
