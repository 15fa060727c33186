"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trajlake.operators import metrics
from trajlake.sources import readers, schemas, sinks


@pytest.fixture
def result_file(tmp_path):
    folder = tmp_path / "model_a"
    folder.mkdir()
    body = {
        "info": {"agent_info": {"llm": "m"}},
        "tasks": [{"id": "7", "evaluation_criteria": {"actions": [{"name": "get", "arguments": {"a": 1}}]}}, {"id": "0"}],
        "simulations": [{"task_id": "7", "reward": 0, "reward_info": {"reward": 0.5, "action_reward_info": {"action_checks": [{"action": {"name": "get"}, "score": 0.0, "found": False}]}}, "messages": [{"role": "user", "content": "hi"}]}],
    }
    (folder / "run_retail_1.json").write_text(json.dumps(body))
    (folder / "summary_1.json").write_text("{}")
    return tmp_path


def test_eval_directory(spark, result_file):
    rows = readers.eval_directory(spark, str(result_file))
    assert [(r["model"], r["domain"]) for r in rows.collect()] == [("model_a", "retail")]
    sim = readers.simulations(rows, "model").first()
    assert sim["reward"] == 0.5 and sim["action_checks"][0]["action"]["name"] == "get"
    keys = {r["key"]: r["task"]["id"] for r in readers.result_tasks(rows).collect()}
    assert keys == {"7": "7", "0": "7", "1": "0"}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 3}\n')
    assert [r["a"] for r in readers.jsonl_tolerant(spark, str(path), "a int").where("a is not null").collect()] == [1, 3]
    good, bad = readers.jsonl_with_rejects(spark, str(path), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert [(r["line"], r["text"]) for r in bad.collect()] == [(3, "not json")]
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl_strict(spark, str(path), "a int").collect()
    assert readers.jsonl_tolerant(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_tool_schema_and_tasks(spark, tmp_path):
    tools = tmp_path / "tools.json"
    tools.write_text(json.dumps([{"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": "string"}, "b": {"type": "integer"}}, "required": ["a"]}}}, {"type": "other"}]))
    got = {(r["tool"], r["param"], r["required"]) for r in readers.tool_schema(spark, str(tools), "d").collect()}
    assert got == {("f", "a", True), ("f", "b", False)}
    (tmp_path / "retail").mkdir()
    task_file = tmp_path / "retail" / "synthetic_tasks_retail.json"
    task_file.write_text('[{"id": "a"}, {"id": "b"}]')
    path = readers.task_path(spark, str(tmp_path), "retail")
    rows = readers.replicated_tasks(readers.tasks(spark, path), ["1"], 3)
    assert [(r["id"], r["trial"]) for r in rows.orderBy("trial").collect()] == [("b", 0), ("b", 1), ("b", 2)]
    assert readers.task_path(spark, str(tmp_path), "telecom", "fallback") == "fallback"
    done = spark.createDataFrame([("d", "b", 0)], schemas.CHECKPOINT)
    sinks.save_checkpoint(done, str(tmp_path / "ck"))
    work = rows.select(F.lit("d").alias("domain"), F.col("id").alias("task_id"), "trial")
    assert readers.pending(work, readers.completed(spark, str(tmp_path / "ck"))).count() == 2
    assert readers.completed(spark, str(tmp_path / "none")).count() == 0


def test_domain_database(spark, tmp_path):
    (tmp_path / "db.json").write_text('{"users": {"u1": {"name": "x"}}}')
    (tmp_path / "db.toml").write_text('[[plans]]\nid = "p1"\n[[plans]]\nid = "p2"\n')
    assert set(readers.domain_database(spark, str(tmp_path))) == {"users"}
    both = readers.domain_database(spark, str(tmp_path), overlay=True)
    assert both["plans"].count() == 2 and both["users"].first()["key"] == "u1"


def test_config():
    got = readers.expand({"a": ["${X:-1}", "${Y}"], "b": 2}, {"Y": "y"})
    assert got == {"a": ["1", "y"], "b": 2}
    assert readers.RunConfig.load({"num_trials": 3}, seed=None).num_trials == 3
    with pytest.raises(ValueError):
        readers.RunConfig.load({"nonsense": 1})
    assert readers.redacted({"api_key": "k", "x": [{"token": "t"}]}) == {"api_key": "***", "x": [{"token": "***"}]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é𝔘x", None), (2, "b", "too few: 2"), (3, "c", "too few: 1")], "id int, t string, reason string")
    sinks.write_jsonl(rows.select("id", "t"), str(tmp_path / "a"), ascii_only=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert {json.loads(x)["t"] for x in lines} == {"é𝔘x", "b", "c"} and all(x.isascii() for x in lines)
    stats = {r["reason"]: r["n"] for r in sinks.write_accepted_rejected(rows, "reason", str(tmp_path / "q")).collect()}
    assert stats == {"accepted": 1, "too few": 2}
    assert spark.read.json(str(tmp_path / "q/rejected")).count() == 2
    sinks.write_partitioned(rows.drop("reason"), str(tmp_path / "p"), "id")
    assert spark.read.json(str(tmp_path / "p")).count() == 3
    sinks.write_concatenated([rows.select("id"), rows.select("id")], str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 6
    assert "| 1 |" in sinks.markdown_table(rows.orderBy("id"), ["id"], "T")
    assert "rate" in sinks.text_report({"rate": 1.5})


def test_summary(spark):
    runs = spark.createDataFrame([("en", 0, 4, 2, 0.5, 50.0), ("fr", 0, 2, 2, 1.0, 100.0)], "domain string, run_id int, num_tasks long, num_success long, avg_reward double, success_rate double")
    domains = metrics.domain_rollup(runs)
    out = sinks.summary_json(domains, metrics.overall_macro(domains), metrics.scores_by_run(runs, ["en", "fr"], 2))
    assert json.loads(out)["scores"] == {"en": [50.0, 0.0], "fr": [100.0, 0.0]} and '"en": [50.0, 0.0]' in out
