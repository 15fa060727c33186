"""Operators over small trajectories: against plain Python where there is a rule, and by their invariants."""

import random

from pyspark.sql import functions as F

from trajlake.operators import errors, generate, inject, metrics, provider, sampling, sequence, validate


def messages(spark, rows):
    return spark.createDataFrame(rows, "traj_id long, idx int, role string, content string")


def test_simulation_metrics(spark):
    call = "array<struct<name:string,arguments:map<string,string>>>"
    sims = spark.createDataFrame(
        [
            (1, 1.0, [("a", {"x": "1"}), ("b", {})], [("a", {"x": "2"}), ("a", {"x": "1"})], ["Error: x", "fine", "failed"], 8, 0),
            (2, 0.0, [], [], [], 0, 5),
        ],
        f"sim int, reward double, expected {call}, calls {call}, results array<string>, n_messages int, expected_turns int",
    )
    one, two = metrics.simulation_metrics(sims).orderBy("sim").collect()
    assert (one["tool_call_accuracy"], one["parameter_accuracy"], one["conversation_efficiency"]) == (0.5, 0.5, 0.5)
    assert (one["n_errors"], one["n_recovered"], one["error_recovery_rate"]) == (2, 1, 0.5)
    assert (two["tool_call_accuracy"], two["conversation_efficiency"], two["error_recovery_rate"]) == (None, 0.0, 1.0)


def test_merge_tool_results(spark):
    rows = [(1, 0, "assistant", "hello", False), (1, 1, "user", "hi", False), (1, 2, "assistant", "c", False), (1, 3, "tool", "r1", False), (1, 4, "tool", "r2", False), (1, 5, "user", "dev", True), (1, 6, "tool", "dev", True), (1, 7, "user", "clean", False), (1, 8, "assistant", "end", False), (1, 9, "user", "bye", False)]
    out = sequence.merge_tool_results(spark.createDataFrame(rows, "traj_id long, idx int, role string, content string, user_side boolean")).orderBy("idx").collect()
    assert [(r["role"], r["content"]) for r in out] == [("user", "hi"), ("assistant", "c"), ("tool", "r1r2"), ("user", "clean"), ("assistant", "end")]


def test_runs_and_subsequence(spark):
    flags = [True, True, False, True, True, True, False]
    assert spark.range(1).select(sequence.longest_error_run(F.array(*map(F.lit, flags))).alias("v")).first()["v"] == 3
    rng = random.Random(1)
    cases = [([rng.choice("abc") for _ in range(rng.randint(0, 5))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    got = spark.createDataFrame(cases, "e array<string>, a array<string>").select("e", "a", sequence.subsequence_matched(F.col("e"), F.col("a")).alias("n")).collect()
    for r in got:
        n = 0
        for x in r["a"]:
            n += n < len(r["e"]) and r["e"][n] == x
        assert n == r["n"]


def test_trajectory_reasons(spark):
    none = F.lit(None).cast("string")
    good = messages(spark, [(1, 0, "system", "s"), (1, 1, "assistant", "c"), (1, 2, "tool", "t"), (2, 0, "user", "u"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "tool", "t")])
    out = {r["traj_id"]: (r["valid"], r["reason"]) for r in validate.trajectory_reasons(good.withColumn("reason", none)).collect()}
    assert out[1] == (True, None)
    assert out[2] == (False, "first message is not system")
    assert out[3][0] is False


def test_action_sequences(spark):
    def reasons(names, n=10, domain="airline"):
        c = validate.action_sequence_reasons(F.array(*map(F.lit, names)), F.lit(n), F.lit(domain))
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert reasons(["get_user", "update_user"]) == []
    assert reasons(["update_user", "get_user"]) == ["update before get"]
    assert reasons(["list_all_airports"]) == ["banned tool"]
    assert reasons(["search_x"] * 6, 40) == ["too many searches", "too many messages"]


def test_splice_adds_two_messages_per_error(spark):
    rows = [(t, i, r, c) for t in (1, 2) for i, (r, c) in enumerate([("system", "s"), ("user", "u"), ("assistant", "call"), ("tool", '{"name": "x", "result": "ok"}'), ("assistant", "call"), ("tool", '{"name": "x", "result": "Error: no"}')])]
    m = messages(spark, rows).withColumn("call_name", F.when(F.col("content") == "call", "x"))
    points = inject.injection_points(m)
    assert [(r["traj_id"], r["idx"]) for r in points.orderBy("traj_id").collect()] == [(1, 2), (2, 2)]
    injected = points.where("traj_id = 1").select("traj_id", "idx", F.lit("w").alias("wrong"), F.lit("e").alias("error"), F.lit("r").alias("recovery"))
    out = inject.splice(m, injected).orderBy("traj_id", "idx").collect()
    assert len(out) == len(rows) + 2
    assert [r["content"] for r in out if r["traj_id"] == 1][:6] == ["s", "u", "w", "e", "r", '{"name": "x", "result": "ok"}']
    assert [r["idx"] for r in out if r["traj_id"] == 1] == list(range(8))


def test_prune_and_votes(spark):
    m = messages(spark, [(1, i, "user", str(i)) for i in range(6)])
    segments = spark.createDataFrame([(1, 1, 3, "fixed")], "traj_id long, start_idx int, fix_idx int, corrected string")
    assert [r["content"] for r in inject.prune_segments(m, segments).orderBy("idx").collect()] == ["0", "fixed", "4", "5"]
    votes = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", False), (1, 2, "a", True), (1, 2, "b", True), (1, 3, "a", False), (2, 1, "a", True), (2, 1, "b", False)], "segment_id int, round int, agent_id string, should_prune boolean")
    out = {r["segment_id"]: (r["prune"], r["decided_round"]) for r in inject.vote_decisions(votes).collect()}
    assert out == {1: (True, 2), 2: (False, 1)}


def test_corruption_changes_values(spark):
    values = ["10", "#W123", "ABC123", "mia_li_2", "free text", "x", "L1001", '["a", "b"]', '{"a": 1, "b": 2}', "2.5", "aa"]
    rows = spark.createDataFrame([(v, k) for v in values for k in range(12)], "v string, k int").select("v", inject.corrupt_json_value(F.col("v"), F.col("k")).alias("w"), validate.same_format(F.col("v"), F.col("v")).alias("same")).collect()
    assert all(r["w"] is not None and r["w"] != r["v"] and r["same"] for r in rows)


def test_samples(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    a = {r["k"] for r in sampling.sample_without_replacement(rows, 50, "k", 1).collect()}
    b = {r["k"] for r in sampling.sample_without_replacement(rows, 20, "k", 1).collect()}
    assert len(a) == 50 and b < a
    weighted = sampling.sample_with_replacement(rows.withColumn("w", F.when(F.col("k") < 2, 100).otherwise(0)), 300, "w", "k", 4)
    assert weighted.count() == 300 and {r["k"] for r in weighted.select("k").distinct().collect()} == {0, 1}
    assert sampling.ratio_merge(rows.limit(0), rows, 0.5, "k", 1).count() == 200
    sizes = {r["scale"]: r["n"] for r in sampling.scaling_subsets(rows, (10, 100, 500), "k", 2).groupBy("scale").agg(F.count("*").alias("n")).collect()}
    assert sizes == {10: 10, 100: 100}
    assert sampling.proportional_allocation(rows.limit(7), 23, "k").agg(F.sum("allocated")).first()[0] == 23


def test_error_db(spark):
    rows = spark.createDataFrame([("d", "t", "Error: #W1 not found", 1), ("d", "t", "Error: #W2 not found", 2), ("d", None, "Error: x", 3), ("d", "t", "Error: #W1 not found", 4)], "domain string, tool string, message string, seq long")
    db = errors.build_error_db(rows)
    out = {(r["tool"], r["error"]): (r["count"], r["examples"]) for r in db.collect()}
    assert out == {("t", "Error: {order_id} not found"): (3, ["Error: #W1 not found", "Error: #W2 not found"]), ("unknown", "Error: x"): (1, ["Error: x"])}
    merged = {(r["tool"], r["error"]): r["count"] for r in errors.merge_error_db(db, db).collect()}
    assert merged[("t", "Error: {order_id} not found")] == 6


def test_provider_and_generation(spark):
    class Flaky:
        def open(self):
            self.calls = 0

        def answer(self, prompts):
            self.calls += 1
            return [None if self.calls < 2 else '```json\n{"ok": true}\n```' for _ in prompts]

    rows = spark.createDataFrame([("a",), (None,)], "p string").coalesce(1)
    got = provider.generate(rows, "p", "answer", Flaky()).select("p", provider.parsed_answer(F.col("answer"), "ok boolean")["ok"].alias("ok")).collect()
    assert {(r["p"], r["ok"]) for r in got} == {("a", True), (None, None)}
    space = spark.createDataFrame([("city", "rome", 3), ("city", "oslo", 1), ("seat", "aisle", 2)], "param string, value string, n long")
    draws = generate.parameter_draws(space, 40, 1)
    templates = spark.createDataFrame([(0, "to {city}, {seat}")], "template_id long, text string")
    texts = [r["text"] for r in generate.instantiate(templates, draws, 2).collect()]
    assert len(texts) == 40 and set(texts) <= {"to rome, aisle", "to oslo, aisle"}
