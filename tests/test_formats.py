"""Native files to metrics, running sums, readers and writers of every form, and providers, on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trajlake.operators import errors, faults, generate, inject, metrics, native, provider, sampling, sequence
from trajlake.operators.numbering import numbered, running_sum
from trajlake.sources import readers, schemas, sinks
from trajlake.streaming import jobs, resume


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


@pytest.fixture
def runs(tmp_path):
    """Two result files with structured calls, nested arguments, user actions, and a task found by position."""
    folder = tmp_path / "m"
    folder.mkdir()
    expected = [{"name": "book", "arguments": {"seats": ["A1", "b2"], "who": {"id": 7}}}, {"name": "pay", "arguments": {"amount": 10}}, {"name": "toggle", "arguments": {}, "requestor": "user"}]
    messages = [
        {"role": "user", "content": "hi"},
        {"role": "assistant", "tool_calls": [call("1", "book", {"seats": ["B2", "a1"], "who": {"id": 8}}), call("2", "look", {})]},
        {"role": "tool", "tool_call_id": "1", "content": "Error: sold"},
        {"role": "tool", "tool_call_id": "2", "content": "fine"},
        {"role": "assistant", "content": "done", "raw_data": {"reasoning_content": "r"}},
    ]
    body = {"tasks": [{"id": "x", "evaluation_criteria": {"actions": expected}}, {"id": "y"}], "simulations": [{"task_id": "0", "reward": 0.0, "reward_info": {"reward": 1.0}, "messages": messages}, {"task_id": "gone", "reward": 1.0, "messages": []}]}
    (folder / "run_retail_0.json").write_text(json.dumps(body))
    return str(tmp_path)


def test_result_files_to_metrics(spark, runs):
    results = readers.eval_directory(spark, runs)
    sims = native.native_simulations(readers.simulations(results, "domain"), readers.result_tasks(results, "domain"), "domain")
    one, two = native.native_metrics(sims).orderBy(F.desc("n_expected")).collect()
    assert (one["reward"], one["n_expected"], one["n_matched"], one["parameter_accuracy"]) == (1.0, 2, 1, 0.25)
    assert (one["n_errors"], one["n_recovered"], one["n_messages"]) == (1, 1, 3)
    assert (two["n_expected"], two["tool_call_accuracy"], two["error_recovery_rate"]) == (0, None, 1.0)
    assert spark.range(1).select(metrics.at_edge(F.lit(None).cast("double")).alias("v")).first()["v"] == -1.0
    overall = metrics.overall_metrics(native.native_metrics(sims)).first()
    assert (overall["n"], overall["n_success"], overall["tool_call_accuracy"]) == (2, 2, 50.0)
    named = sims.where("size(messages) > 0").select(native.named_results(F.col("messages")).alias("r"), native.agent_responses(F.col("messages")).alias("a"), native.structured_calls(F.col("messages")).alias("c")).first()
    assert [(r["tool"], r["is_error"]) for r in named["r"]] == [("book", True), ("look", False)]
    assert [a["reasoning_content"] for a in named["a"]] == [None, "r"] and [c["number"] for c in named["c"]] == [0, 1]


@pytest.mark.parametrize("kind", ["number", "text", "time"])
def test_running_sums_equal_brute_force(spark, kind):
    rng = random.Random(3)
    keys = [None, *[rng.randrange(300) for _ in range(500)]]
    made = {"number": lambda k: k, "text": lambda k: f"é{k:03d}", "time": lambda k: f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"}[kind]
    rows = [(None if k is None else made(k), i, i % 7) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, f"k {'long' if kind == 'number' else 'string'}, i long, v long").repartition(5)
    frame = frame.withColumn("k", F.col("k").cast("timestamp")) if kind == "time" else frame
    got = {r["i"]: (r["s"], r["n"]) for r in numbered(running_sum(frame, ["k", "i"], F.col("v"), "s", ranges=16), ["k", "i"], "n").collect()}
    total = 0
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))):
        total += v
        assert got[i] == (total, n)
    assert numbered(frame.limit(0), ["k"], "n").collect() == []


def test_lines_are_strict_and_numbered(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f'{{"a": {k}}}\n' for k in range(5000)) + '{"a": 1}{"a": 2}\n\n{"a": 9} x\n{"a": 3}\n[1]\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert readers.jsonl_tolerant(spark, str(path), "a int").count() == 5001
        good, bad = readers.jsonl_with_rejects(spark, str(path), "a int")
        assert good.count() == 5001
        assert sorted((r["line"], r["text"]) for r in bad.collect()) == [(5001, '{"a": 1}{"a": 2}'), (5003, '{"a": 9} x'), (5005, "[1]")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_readers(spark, tmp_path):
    (tmp_path / "db.json").write_text('{"users": {"u": {"n": {"f": "é"}}}, "list": [{"a": 1}, {"a": 2}], "version": 3}')
    tables = readers.domain_database(spark, str(tmp_path))
    assert set(tables) == {"users", "list"} and json.loads(tables["users"].first()["value"]) == {"n": {"f": "é"}}
    assert sorted((r["key"], r["value"]) for r in tables["list"].collect()) == [("0", '{"a":1}'), ("1", '{"a":2}')]
    with pytest.raises(FileNotFoundError):
        readers.domain_database(spark, str(tmp_path / "none"))
    assert readers.seed_tasks(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.seed_tasks(spark, str(tmp_path / "none.json"), must_exist=True)
    (tmp_path / "t.jsonl").write_text('{"id": "b"}\n{"id": "a"}\n{"id": "c"}\n')
    rows = readers.seed_tasks(spark, str(tmp_path / "t.jsonl"))
    assert [r["id"] for r in readers.task_prefix(rows, 2).collect()] == ["a", "b"]
    assert readers.error_db(spark, str(tmp_path / "nothing")).count() == 0
    results = spark.createDataFrame([("d", "t", "Error: 1 x", 1), ("d", "t", "Error: 2 x", 2)], "domain string, tool string, message string, seq long")
    db = errors.build_error_db(results)
    db.write.parquet(str(tmp_path / "edb"))
    assert readers.error_db(spark, str(tmp_path / "edb")).first()["count"] == 2
    assert [tuple(r) for r in errors.error_db_stats_by_tool(db).collect()] == [("d", "t", 1, 2)]


def test_settings(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("task_name: ${NAME:-none}\nagent: {base_url: u, model_id: a, api_key: '${KEY}'}\nuser: {base_url: u, model_id: b}\nnum_runs: 3\n")
    value = readers.settings(spark, str(tmp_path / "c.yaml"), {"KEY": "k"})
    config = readers.EvalConfig.load(value, num_trials=2)
    assert (config.task_name, config.agent.api_key, config.user.max_tokens, config.synthetic_num_runs, config.num_trials) == ("none", "k", 4096, 3, 2)
    sinks.write_config(spark, config, str(tmp_path / "out" / "config.json"))
    assert json.loads((tmp_path / "out" / "config.json").read_text())["agent"]["api_key"] == "***"
    assert readers.GenerationConfig.load({}).complexity_weights["medium"] == 0.5
    with pytest.raises(ValueError):
        readers.EvalConfig.load({"task_name": "x", "agent": {"nonsense": 1}, "user": {}})


def test_reports_and_writers(spark, tmp_path):
    from trajlake.operators import reports

    sims = spark.createDataFrame([("a", 1.0, 3, "max_steps"), ("a", 0.0, 5, None), ("b", 1.0, 1, "stop")], "domain string, reward double, n_steps int, termination_reason string")
    checks = spark.createDataFrame([("a", "get", 0.0, False), ("a", "buy", 0.0, None), ("a", "buy", 1.0, True)], "domain string, action string, score double, found boolean")
    text = sinks.failure_report(reports.domain_statistics(sims), reports.terminations(sims), reports.failing_actions(checks), "T")
    assert text.index("| a | 50.0 |") < text.index("| b | 100.0 |") and "| a | get | 1 |" in text and "| a | buy | 1 |" in text and "unknown" in text
    assert "98 more rows are not shown" in sinks.markdown_table(spark.range(100), ["id"], "T", 2)
    stats = json.loads(sinks.statistics_json(reports.domain_statistics(sims), sims.agg(F.count("*").alias("n"))))
    assert stats["overall"] == {"n": 3} and stats["domains"]["b"]["total_steps"] == 1
    rows = spark.createDataFrame([("t1", 1, 0.0, "x", "[]", "m"), ("t2", 2, 1.0, "x", "[]", "m")], "task_id string, attempt int, reward double, termination string, tools string, messages string")
    sinks.write_failed(rows, str(tmp_path / "f"), str(tmp_path / "s"))
    assert [r["metadata"]["task_id"] for r in spark.read.json(str(tmp_path / "f")).collect()] == ["t1"] and spark.read.json(str(tmp_path / "s")).columns == ["messages", "tools"]
    analyses = spark.createDataFrame([("error", "t1", 1, 0.0, "why"), ("contrast", "t1", 1, 0.0, "how")], "kind string, task_id string, attempt int, reward double, analysis string")
    sinks.write_analyses(analyses, str(tmp_path / "an"))
    assert sorted(r["kind"] for r in spark.read.json(str(tmp_path / "an")).collect()) == ["contrast", "error"]
    latest = jobs.latest_success(spark.createDataFrame([("t", 1, 1.0, "a"), ("t", 3, 1.0, "c"), ("t", 4, 0.0, "d")], "task_id string, attempt int, reward double, trajectory string"))
    assert [tuple(r) for r in latest.collect()] == [("t", 3, "c")]


def test_work_resumes(spark, tmp_path):
    tasks = spark.createDataFrame([("d", f"t{k}", 0) for k in range(6)], schemas.CHECKPOINT)
    sinks.save_checkpoint(tasks.limit(2), str(tmp_path / "keys"))
    tasks.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schemas.CHECKPOINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        resume.run_and_checkpoint(stream, lambda todo: todo.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "ck"), readers.completed(spark, str(tmp_path / "keys"))).awaitTermination()
    assert resume.results(spark, str(tmp_path / "out"), "domain string, task_id string, trial int, done boolean").count() == 4 and resume.completed(spark, str(tmp_path / "out")).count() == 4


def scripted(folder=None):
    class Scripted:
        """Answers by what a prompt asks for; the first answer to a prompt marked ``late`` is no JSON."""

        def open(self):
            pass

        def first(self, p):
            mark = folder / str(len(p))
            return not mark.exists() and not mark.touch()

        def answer(self, prompts):
            return [self.one(p) for p in prompts]

        def one(self, p):
            if "never" in p or ("late" in p and self.first(p)):
                return "sorry"
            if "Find the segments" in p:
                return '{"segments": [{"start": 1, "end": 2}]}'
            if "You are agent" in p:
                return json.dumps({"prune": "agent 1" in p or "keep" not in p})
            if "wrong call" in p:
                return json.dumps({"wrong_arguments": '{"id": "#W99"}' if "good" in p else '{"id": "zzz"}', "error_message": "Error: no"})
            return json.dumps({"reason": "r", "tools": ["t"], "persona": "p", "instructions": "i", "actions": ["a"], "assertions": []})

    return Scripted()


def test_provider_chains(spark, tmp_path):
    seeds = spark.createDataFrame([(1, "plain"), (2, "late"), (3, "never")], "seed_id long, prompt string").coalesce(1)
    chain = provider.design_chain(seeds, scripted(tmp_path))
    assert sorted(r["seed_id"] for r in chain.collect()) == [1, 2] and json.loads(chain.first()["criteria"])["actions"] == ["a"]
    messages = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(("user", "user", "user", "tool", "assistant"))], "traj_id long, idx long, role string, content string")
    assert [tuple(r) for r in provider.detected_segments(messages, scripted()).collect()] == [(1, 1, 2, 4)]
    votes = provider.votes_of(spark.createDataFrame([(1, "drop it"), (2, "keep it")], "segment_id long, p string"), "p", 3, 2, scripted())
    assert votes.count() == 12
    assert {r["segment_id"]: r["prune"] for r in inject.vote_decisions(votes).collect()} == {1: True, 2: False}


def test_errors_by_rule_and_by_agent(spark):
    points = spark.createDataFrame([("1", "d", "t", '{"id": "#W12"}', "good"), ("2", "d", "t", '{"id": "#W12"}', "bad form"), ("3", "d", "t", "{}", "good")], "key string, domain string, tool string, arguments string, note string")
    db = spark.createDataFrame([("d", "other", "x", 1)], "domain string, tool string, error string, count long")
    got = {r["key"]: (r["wrong"], r["error"], r["source"]) for r in provider.inject_errors(points, "agent", db, 1, scripted(), F.concat(F.lit("a wrong call, "), "note")).collect()}
    assert got["1"] == ('{"id": "#W99"}', "Error: no", "provider") and got["2"][2] == "rule" and set(got) == {"1", "2"}
    rule = provider.inject_errors(points, "rule", db, 1)
    assert {r["key"] for r in rule.collect()} == {"1", "2"} and rule.where("wrong = '{\"id\": \"#W12\"}'").count() == 0
    with pytest.raises(ValueError):
        provider.inject_errors(points, "other", db, 1)
    merged = faults.with_templates(points, spark.createDataFrame([("state", "d", None, "closed")], "kind string, domain string, tool string, text string"))
    assert {tuple(r["_state"]) for r in merged.collect()} == {("closed",)}


def test_attempts_learn(spark):
    tasks = spark.createDataFrame([("easy", "p"), ("hard", "p"), ("hopeless", "p")], "task_id string, prompt string")

    def attempt(rows, number):
        good = (F.col("task_id") == "easy") | ((F.col("task_id") == "hard") & F.contains("prompt", F.lit("hint")))
        return rows.select("task_id", "prompt", good.cast("double").alias("reward"), F.concat("prompt", F.lit("!")).alias("trajectory"))

    out = provider.attempt_loop(tasks, attempt, lambda failed: failed.select("task_id", F.lit("hint").alias("analysis")), 3)
    assert sorted((r["task_id"], r["attempt"], r["reward"]) for r in out.collect()) == [("easy", 1, 1.0), ("hard", 1, 0.0), ("hard", 2, 1.0), ("hopeless", 1, 0.0), ("hopeless", 2, 0.0), ("hopeless", 3, 0.0)]


def test_samples_of_whole_tables(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    ordered = [r["k"] for r in sampling.shuffled(rows, "k", 5).collect()]
    assert sorted(ordered) == list(range(1000)) and ordered != sorted(ordered)
    for n in (0, 1, 500, 1000, 2000):
        assert {r["k"] for r in sampling.hash_prefix(rows, n, "k", 5).collect()} == set(ordered[:n])
    apis = spark.createDataFrame([(f"c{k % 6}", k) for k in range(60)], "category string, api long")
    for seed in range(12):
        sizes = sorted(r["n"] for r in sampling.category_sample(apis, seed).groupBy("category").agg(F.count("*").alias("n")).collect())
        assert 1 <= len(sizes) <= 3 and 5 <= sizes[-1] <= 10 and all(2 <= n <= 5 for n in sizes[:-1])
    assert generate.persona_table(spark).where("weight > 0").count() == 8
    tasks = spark.createDataFrame([("a", "r", [("x",)]), ("b", "r", [])], "task_id string, reason string, actions array<struct<name:string>>")
    assert {(r["task_id"], tuple(r["tools"]), r["frequency"]) for r in generate.patterns(tasks).collect()} == {("a", ("x",), 0.5), ("b", (), 0.5)}
    assert spark.range(1).select(inject.error_message(F.lit("p"), F.lit("w"), F.lit(1)).alias("v")).first()["v"] == "Parameter 'p' validation failed: expected valid identifier, got 'w'"


def test_user_side_calls_only(spark):
    rows = [(1, 0, "user", "u", False), (1, 1, "user", "dev", True), (1, 2, "tool", "r", False), (1, 3, "assistant", "still here", False), (1, 4, "user", "clean", False), (1, 5, "tool", "kept", False), (1, 6, "assistant", "end", False)]
    out = sequence.merge_tool_results(spark.createDataFrame(rows, "traj_id long, idx int, role string, content string, user_side boolean")).orderBy("idx").collect()
    assert [r["content"] for r in out] == ["u", "still here", "clean", "kept", "end"]
