"""Registered queries: each operator over the driver's tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlake.functions import matching, scoring, text
from trajlake.operators import errors, inject, metrics, reports, sampling, sequence, validate
from trajlake.operators.numbering import numbered
from trajlake.plans.adapters import conversation_messages, event_messages, labelled_runs, order_actions, table
from trajlake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  QUERIES is read from here

RUNS = """runs AS (SELECT domain, run_id, count(*) AS num_tasks, count(*) FILTER (reward > 0) AS num_success, avg(reward) AS avg_reward,
 count(*) FILTER (reward > 0) * 100 / count(*) AS success_rate FROM lab GROUP BY domain, run_id)"""
ROLLUP = """domains AS (SELECT domain, count(*) AS num_runs, CAST(sum(num_tasks) AS BIGINT) AS total_tasks, CAST(sum(num_success) AS BIGINT) AS total_success,
 CAST(round(CAST(sum(avg_reward * num_tasks) / sum(num_tasks) AS DECIMAL(38,12)), 4) AS DOUBLE) AS avg_reward,
 CAST(round(CAST(sum(num_success) * 100 / sum(num_tasks) AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_success_rate FROM runs GROUP BY domain)"""


# --- runs and roll-ups -------------------------------------------------------------------------------------------


@query(f"WITH {RUNS} SELECT * FROM runs", "lab")
def run_success_by_domain_run(spark, d):
    return metrics.run_results(labelled_runs(spark, d))


@query(f"WITH {RUNS}, {ROLLUP} SELECT * FROM domains", "lab")
def domain_rollup(spark, d):
    return metrics.domain_rollup(metrics.run_results(labelled_runs(spark, d)))


@query(
    f"""WITH {RUNS}, {ROLLUP} SELECT count(*) AS num_domains, CAST(sum(total_tasks) AS BIGINT) AS total_tasks, CAST(sum(total_success) AS BIGINT) AS total_success,
 CAST(round(CAST(avg(avg_reward) AS DECIMAL(38,12)), 4) AS DOUBLE) AS avg_reward, CAST(round(CAST(avg(avg_success_rate) AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_success_rate FROM domains""",
    "lab",
)
def overall_macro(spark, d):
    return metrics.overall_macro(metrics.domain_rollup(metrics.run_results(labelled_runs(spark, d))))


@query(
    f"""WITH {RUNS}, spine AS (SELECT dom.domain, r.run_id FROM (SELECT DISTINCT domain FROM lab) dom, (VALUES (0), (1), (2), (3), (4)) r(run_id)),
 scores AS (SELECT s.domain, s.run_id, CAST(round(CAST(coalesce(runs.success_rate, 0.0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS score FROM spine s LEFT JOIN runs ON runs.domain = s.domain AND runs.run_id = s.run_id)
 SELECT run_id, max(score) FILTER (domain = 'de') AS de, max(score) FILTER (domain = 'en') AS en, max(score) FILTER (domain = 'es') AS es, max(score) FILTER (domain = 'fr') AS fr,
 CAST(round(CAST(sum(score) / 4 AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_per_run FROM scores GROUP BY run_id""",
    "lab",
)
def scores_pivot_zero_filled(spark, d):
    """All languages that occur, and a fifth run that no language has: zeros."""
    runs = labelled_runs(spark, d)
    domains = [r["domain"] for r in runs.select("domain").distinct().orderBy("domain").collect()]  # few languages
    return metrics.scores_pivot(metrics.scores_by_run(metrics.run_results(runs), domains, 5), domains)


@query(
    f"""WITH {RUNS}, spine AS (SELECT dom.domain, r.run_id FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) dom(domain), (VALUES (0), (1), (2), (3)) r(run_id)),
 scores AS (SELECT s.domain, s.run_id, CAST(round(CAST(coalesce(runs.success_rate, 0.0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS score FROM spine s LEFT JOIN runs ON runs.domain = s.domain AND runs.run_id = s.run_id)
 SELECT run_id, max(score) FILTER (domain = 'en') AS en, max(score) FILTER (domain = 'fr') AS fr, max(score) FILTER (domain = 'de') AS de, max(score) FILTER (domain = 'es') AS es, max(score) FILTER (domain = 'xx') AS xx,
 CAST(round(CAST(sum(score) / 5 AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_per_run FROM scores GROUP BY run_id""",
    "lab",
)
def scores_pivot_all_domains(spark, d):
    """All four languages; 'xx' has no runs and shows the zero filling."""
    domains = ["en", "fr", "de", "es", "xx"]
    return metrics.scores_pivot(metrics.scores_by_run(metrics.run_results(labelled_runs(spark, d)), domains, 4), domains)


@query("SELECT source, domain, count(*) AS num_tasks, count(*) FILTER (reward > 0) AS num_success FROM lab GROUP BY source, domain", "lab")
def source_split_summary(spark, d):
    return metrics.run_results(labelled_runs(spark, d), ("source", "domain")).select("source", "domain", "num_tasks", "num_success")


@query(
    """WITH s AS (SELECT traj_id, count(*) FILTER (role IN ('user','assistant')) AS turns FROM conv GROUP BY traj_id)
 SELECT traj_id, turns, CASE WHEN turns = 0 THEN 0.0 ELSE least(CAST(4 AS DOUBLE) / turns, 1.0) END AS efficiency FROM s""",
    "conv",
)
def sim_turn_efficiency(spark, d):
    turns = conversation_messages(spark, d).groupBy("traj_id").agg(F.count_if(F.col("role").isin("user", "assistant")).alias("turns"))
    return turns.withColumn("efficiency", F.when(F.col("turns") == 0, 0.0).otherwise(F.least(4.0 / F.col("turns"), F.lit(1.0))))


def _event_sims(spark, d):
    """A simulation for each user: calls, results, and the expected calls click then purchase."""
    m = event_messages(spark, d)
    ordered = lambda c: F.array_sort(F.collect_list(c))
    grouped = m.groupBy("traj_id").agg(
        F.transform(ordered(F.when(F.col("kind") == "call", F.struct("idx", "name", F.get_json_object("props", "$.k").alias("k")))), lambda c: F.struct(c["name"].alias("name"), F.create_map(F.lit("k"), c["k"]).alias("arguments"))).alias("calls"),
        F.transform(ordered(F.when(F.col("role").isin("tool"), F.struct("idx", "content"))), lambda c: c["content"]).alias("results"),
        F.count_if(F.col("role").isin("user", "assistant")).cast("int").alias("n_messages"),
        F.count_if(F.col("name") == "purchase").alias("n_purchase"),
    )
    expected = F.array(*[F.struct(F.lit(n).alias("name"), F.create_map(F.lit("k"), F.lit(v)).alias("arguments")) for n, v in (("click", "1"), ("purchase", "77"), ("refund", "3"))])
    return grouped.withColumns({"reward": (F.col("n_purchase") % 2).cast("double"), "expected": expected, "expected_turns": F.lit(20)}).drop("n_purchase")


SIMS = """s AS (SELECT traj_id, count(*) FILTER (role IN ('user','assistant')) AS n_messages, CAST(count(*) FILTER (name = 'purchase') % 2 AS DOUBLE) AS reward,
  count(*) FILTER (is_error) AS n_errors,
  coalesce(max(CASE WHEN name = 'click' THEN CASE WHEN abs(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 1) < 0.001 THEN 1.0 ELSE 0.0 END END), -1) AS c1,
  coalesce(max(CASE WHEN name = 'purchase' THEN CASE WHEN abs(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 77) < 0.001 THEN 1.0 ELSE 0.0 END END), -1) AS c2 FROM evt GROUP BY traj_id),
 m AS (SELECT traj_id, reward > 0 AS success, n_errors, CASE WHEN reward > 0 THEN greatest(n_errors - 1, 0) ELSE 0 END AS n_recovered,
  ((c1 >= 0)::INT + (c2 >= 0)::INT) AS n_matched, ((c1 >= 0)::INT + (c2 >= 0)::INT) / 3 AS tool_call_accuracy, (greatest(c1, 0) + greatest(c2, 0)) / 3 AS parameter_accuracy,
  CASE WHEN n_messages = 0 THEN 0.0 ELSE least(CAST(20 AS DOUBLE) / n_messages, 1.0) END AS conversation_efficiency,
  CASE WHEN n_errors = 0 THEN 1.0 WHEN reward > 0 THEN greatest(n_errors - 1, 0) / n_errors ELSE 0.0 END AS error_recovery_rate FROM s)"""
SIM_COLUMNS = ("traj_id", "success", "n_errors", "n_recovered", "n_matched", "tool_call_accuracy", "parameter_accuracy", "conversation_efficiency", "error_recovery_rate")


@query(f"WITH {SIMS} SELECT * FROM m", "evt")
def sim_error_recovery(spark, d):
    return metrics.simulation_metrics(_event_sims(spark, d)).select(*SIM_COLUMNS)


@query(
    f"""WITH {SIMS} SELECT count(*) AS n, count(*) FILTER (success) AS n_success, CAST(round(avg(tool_call_accuracy) * 100, 6) AS DOUBLE) AS tool_call_accuracy, round(avg(parameter_accuracy) * 100, 6) AS parameter_accuracy,
 round(avg(conversation_efficiency) * 100, 6) AS conversation_efficiency, round(avg(error_recovery_rate) * 100, 6) AS error_recovery_rate, CAST(sum(n_errors) AS BIGINT) AS total_n_errors, CAST(sum(n_recovered) AS BIGINT) AS total_n_recovered FROM m""",
    "evt",
)
def extended_metrics_overall(spark, d):
    out = metrics.overall_metrics(metrics.simulation_metrics(_event_sims(spark, d)))
    return out.select("n", "n_success", *[F.round(m, 6).alias(m) for m in metrics.METRICS], "total_n_errors", "total_n_recovered")


# --- matching -----------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT DISTINCT task_id, name FROM ord WHERE called)
 SELECT o.task_id, count(*) AS n_expected, count(c.name) AS n_matched FROM ord o LEFT JOIN c ON c.task_id = o.task_id AND c.name = o.name GROUP BY o.task_id""",
    "ord",
)
def action_name_match(spark, d):
    called = F.collect_set(F.when(F.col("called"), F.col("name")))
    grouped = order_actions(spark, d).groupBy("task_id").agg(F.collect_list("name").alias("e"), called.alias("c"))
    return grouped.select("task_id", F.size("e").cast("long").alias("n_expected"), F.size(F.filter("e", lambda n: F.array_contains("c", n))).cast("long").alias("n_matched"))


@query(
    """WITH r AS (SELECT *, row_number() OVER () AS rid FROM ord), p AS (SELECT o.task_id, o.rid, max(CASE WHEN c.task_id IS NULL THEN NULL ELSE ((abs(o.quantity - c.quantity) < 0.001)::INT + (abs(o.discount - c.discount) < 0.001)::INT) / 2 END) AS best
 FROM r o LEFT JOIN r c ON c.task_id = o.task_id AND c.name = o.name AND c.called GROUP BY o.task_id, o.rid)
 SELECT task_id, round(sum(coalesce(best, 0.0)) / count(*), 9) AS parameter_accuracy FROM p GROUP BY task_id""",
    "ord",
)
def param_partial_score(spark, d):
    args = F.create_map(F.lit("q"), F.col("quantity").cast("string"), F.lit("d"), F.col("discount").cast("string"))
    rows = order_actions(spark, d).withColumn("a", F.struct("name", args.alias("arguments")))
    grouped = rows.groupBy("task_id").agg(F.collect_list("a").alias("e"), F.collect_list(F.when(F.col("called"), F.col("a"))).alias("c"))
    best = F.transform("e", lambda e: F.array_max(F.transform(F.filter("c", lambda c: c["name"] == e["name"]), lambda c: matching.parameter_score(e["arguments"], c["arguments"]))))
    return grouped.select("task_id", F.round(F.aggregate(best, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))) / F.size("e"), 9).alias("parameter_accuracy"))


@query(
    """SELECT traj_id, list_reduce(list_prepend(0, list(CASE name WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END ORDER BY idx)), lambda i, a: CASE WHEN i = 0 AND a = 1 THEN 1 WHEN i = 1 AND a = 2 THEN 2 WHEN i = 2 AND a = 3 THEN 3 WHEN i = 3 AND a = 1 THEN 4 ELSE i END) AS matched FROM evt WHERE kind = 'call' GROUP BY traj_id""",
    "evt",
)
def greedy_subsequence_reward(spark, d):
    calls = event_messages(spark, d).where("kind = 'call'").groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda c: c["name"]).alias("actual"))
    expected = F.array(*map(F.lit, ("click", "signup", "purchase", "click")))
    return calls.select("traj_id", sequence.subsequence_matched(expected, F.col("actual")).alias("matched"))


@query(
    """WITH t AS (SELECT task_id, count(*) AS n, count(DISTINCT name) AS kinds, count(*) FILTER (called) AS done, count(*) FILTER (discount > 5) AS talk FROM ord GROUP BY task_id)
 SELECT task_id, round(0.4 * (done / n) + 0.4 * (1.0 / kinds) + 0.2 * least(talk / 3, 1.0), 9) AS score_v1, round(0.35 * (done / n) + 0.35 * (1.0 / kinds) + 0.30 * CASE WHEN n - done = 0 THEN 1.0 ELSE least(talk, n - done) / (n - done) END, 9) AS score_v2 FROM t""",
    "ord",
)
def quality_scores(spark, d):
    t = order_actions(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("kinds"), F.count_if("called").alias("done"), F.count_if(F.col("discount") > 5).alias("talk"))
    complete, parameters = F.col("done") / F.col("n"), 1.0 / F.col("kinds")
    missing = F.col("n") - F.col("done")
    return t.select("task_id", F.round(scoring.quality_score_v1(complete, parameters, F.col("talk")), 9).alias("score_v1"), F.round(scoring.quality_score_v2(complete, parameters, F.least("talk", missing), missing), 9).alias("score_v2"))


# --- grades -------------------------------------------------------------------------------------------------------

TIER = "CASE WHEN r >= 0.95 THEN 'PLATINUM' WHEN r >= 0.9 THEN 'GOLD' WHEN r >= 0.75 THEN 'SILVER' WHEN r >= 0.6 THEN 'BRONZE' ELSE 'FAILED' END"


@query(f"WITH t AS (SELECT task_id, (task_id * 37 % 101) / 100 AS r FROM lab) SELECT task_id, {TIER} AS tier, r >= 0.75 AS saved FROM t", "lab")
def reward_tier(spark, d):
    r = F.pmod(F.col("task_id") * 37, F.lit(101)) / 100
    return labelled_runs(spark, d).select("task_id", scoring.reward_tier(r).alias("tier"), scoring.should_save(r, "SILVER").alias("saved"))


DIFFICULTY = """w AS (SELECT task_id, count(*) AS n, max(discount) >= 9 AS sensitive, sum(quantity) > 150 AS long_text, count(*) FILTER (name = 'RF') AS weak, count(*) FILTER (NOT called) / count(*) AS fail FROM ord GROUP BY task_id),
 x AS (SELECT task_id, n, least(5.0, (1.0 + (n >= 3)::INT + 1.5 * sensitive::INT + long_text::INT + 0.5 * weak) * (1 + fail)) AS weight FROM w)"""


def _difficulty(spark, d):
    t = order_actions(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), (F.max("discount") >= 9).alias("sensitive"), (F.sum("quantity") > 150).alias("long_text"), F.count_if(F.col("name") == "RF").alias("weak"), (F.count_if(~F.col("called")) / F.count("*")).alias("fail"))
    return t.select("task_id", "n", scoring.difficulty_weight(F.col("n"), F.col("sensitive"), F.col("long_text"), F.col("weak"), F.col("fail")).alias("weight"))


@query(f"WITH {DIFFICULTY} SELECT task_id, round(weight, 9) AS weight, CASE WHEN n <= 2 THEN 'simple' WHEN n <= 5 THEN 'medium' ELSE 'complex' END AS complexity FROM x", "ord")
def difficulty_weight(spark, d):
    return _difficulty(spark, d).select("task_id", F.round("weight", 9).alias("weight"), scoring.complexity(F.col("n")).alias("complexity"))


@query(f"WITH {DIFFICULTY} SELECT count(*) AS total, count(*) FILTER (weight >= 3.0) AS high_priority, count(*) FILTER (weight >= 2.0 AND weight < 3.0) AS weak, count(*) FILTER (n >= 3) AS multi_step FROM x", "ord")
def difficulty_distribution(spark, d):
    w = F.col("weight")
    return _difficulty(spark, d).agg(F.count("*").alias("total"), F.count_if(w >= 3.0).alias("high_priority"), F.count_if((w >= 2.0) & (w < 3.0)).alias("weak"), F.count_if(F.col("n") >= 3).alias("multi_step"))


@query(f"WITH {DIFFICULTY} SELECT task_id, round(weight, 9) AS weight FROM x ORDER BY weight DESC, task_id LIMIT 50", "ord")
def priority_order_topk(spark, d):
    return _difficulty(spark, d).orderBy(F.desc("weight"), "task_id").limit(50).select("task_id", F.round("weight", 9).alias("weight"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type || ' ' || p_name), 'cancel') THEN 'cancellation' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'book|reservation') THEN 'booking'
 WHEN regexp_matches(lower(p_type || ' ' || p_name), 'modify|change|update') THEN 'modification' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'check|status|track|query') THEN 'inquiry'
 WHEN regexp_matches(lower(p_type || ' ' || p_name), 'compensat|refund|delay') THEN 'compensation' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'exchange|return') THEN 'exchange'
 WHEN regexp_matches(lower(p_type || ' ' || p_name), 'suspend|resume') THEN 'service_control' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'payment|bill') THEN 'billing' ELSE 'other' END AS task_type FROM part"""
)
def task_type_case(spark, d):
    return table(spark, d, "part").select("p_partkey", scoring.task_type(F.concat_ws(" ", "p_type", "p_name")).alias("task_type"))


# --- history and order --------------------------------------------------------------------------------------------


@query("SELECT source AS task_key, count(*) AS attempts, count(*) FILTER (reward = 0) AS failures, count(*) FILTER (reward = 0) / count(*) AS fail_rate FROM lab GROUP BY source", "lab")
def failure_history(spark, d):
    runs = labelled_runs(spark, d)
    failures = F.count_if(F.col("reward") == 0)
    return runs.groupBy(F.col("source").alias("task_key")).agg(F.count("*").alias("attempts"), failures.alias("failures"), (failures / F.count("*")).alias("fail_rate"))


@query(
    """WITH h AS (SELECT source, count(*) FILTER (reward = 0) AS failures, count(*) FILTER (reward = 0) / count(*) AS fail_rate FROM lab GROUP BY source)
 SELECT count(*) AS tasks, count(*) FILTER (failures > 0) AS with_failures, round(avg(fail_rate), 9) AS mean_fail_rate FROM h""",
    "lab",
)
def sampler_stats(spark, d):
    h = failure_history(spark, d)
    return h.agg(F.count("*").alias("tasks"), F.count_if(F.col("failures") > 0).alias("with_failures"), F.round(F.avg("fail_rate"), 9).alias("mean_fail_rate"))


@query(
    """SELECT task_id, sum((reward = 0)::INT) OVER w / count(*) OVER w AS running_fail_rate FROM lab WINDOW w AS (PARTITION BY source ORDER BY task_id ROWS UNBOUNDED PRECEDING)""",
    "lab",
)
def running_fail_rate(spark, d):
    rows = labelled_runs(spark, d).withColumn("failed", F.col("reward") == 0)
    return sequence.running_fail_rate(rows, "source", "task_id").select("task_id", "running_fail_rate")


@query("SELECT task_id, source, row_number() OVER (PARTITION BY source ORDER BY task_id) - 1 AS trial FROM lab", "lab")
def trial_index(spark, d):
    return sequence.trial_index(labelled_runs(spark, d), "source", "task_id").select("task_id", "source", F.col("trial").cast("long").alias("trial"))


@query("SELECT task_id, domain, row_number() OVER (PARTITION BY domain ORDER BY task_id) AS turn FROM lab", "lab")
def round_robin_interleave(spark, d):
    return sequence.round_robin(labelled_runs(spark, d), "domain", "task_id").select("task_id", "domain", F.col("turn").cast("long").alias("turn"))


@query(
    """WITH r AS (SELECT traj_id, idx, is_error, sum((NOT is_error)::INT) OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM evt WHERE role = 'tool' OR name = 'click')
 SELECT traj_id, min(idx) AS run_start, count(*) AS run_length FROM r WHERE is_error GROUP BY traj_id, island""",
    "evt",
)
def consecutive_error_runs(spark, d):
    rows = event_messages(spark, d).where("role = 'tool' OR name = 'click'")
    return sequence.error_runs(rows).select("traj_id", F.col("run_start").cast("long").alias("run_start"), "run_length")


@query(
    """WITH n AS (SELECT *, lead(role) OVER (PARTITION BY traj_id ORDER BY idx) AS next_role FROM evt),
 a AS (SELECT traj_id, count(*) FILTER (is_error) AS n_errors, count(*) FILTER (is_error AND coalesce(next_role, 'assistant') <> 'assistant') AS n_unanswered FROM n GROUP BY traj_id),
 l AS (SELECT traj_id, count(*) AS n FROM evt WHERE role = 'tool' GROUP BY traj_id)
 SELECT a.traj_id, n_errors, coalesce(l.n, 0) AS longest_run, n_unanswered, n_errors <= 8 AND coalesce(l.n, 0) <= 3 AND n_unanswered = 0 AS valid FROM a LEFT JOIN l ON l.traj_id = a.traj_id""",
    "evt",
)
def error_recovery_valid(spark, d):
    return sequence.recovery_check(event_messages(spark, d))


# --- validation ---------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT traj_id, idx, CASE WHEN row_number() OVER (PARTITION BY traj_id ORDER BY idx) = 1 AND role <> 'system' THEN 'first message is not system' WHEN coalesce(trim(content), '') = '' THEN 'empty content' END AS why FROM conv)
 SELECT traj_id, count(why) = 0 AS valid, arg_min(why, idx) FILTER (why IS NOT NULL) AS reason FROM o GROUP BY traj_id""",
    "conv",
)
def role_sequence_valid(spark, d):
    rows = conversation_messages(spark, d)
    none = F.lit(None).cast("string")
    call = text.first_tool_call(F.col("content"))
    rows = rows.withColumn("reason", F.when(F.col("role") == "tool", none).otherwise(validate.message_reason(F.col("role"), F.col("content"), call["name"], call["arguments"], none)))
    return validate.trajectory_reasons(rows)


@query(
    """WITH t AS (SELECT traj_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (role = 'assistant') AS calls, count(*) FILTER (length(content) > 600) AS hall, traj_id % 7 AS q FROM conv GROUP BY traj_id)
 SELECT traj_id, CASE WHEN turns < 3 THEN 'too few turns' WHEN turns > 30 THEN 'too many turns' WHEN calls < 2 THEN 'too few calls' WHEN calls > 0 AND hall > 0.3 * calls THEN 'hallucination rate' WHEN q < 3 THEN 'low quality' END AS reason FROM t""",
    "conv",
)
def quality_filter_flags(spark, d):
    t = conversation_messages(spark, d).groupBy("traj_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count_if(F.col("role") == "assistant").alias("calls"), F.count_if(F.length("content") > 600).alias("hall"))
    return t.select("traj_id", validate.quality_filter_reason(F.col("turns"), F.col("calls"), F.col("hall"), F.col("traj_id") % 7).alias("reason"))


@query(f"WITH f AS ({ORACLE_SQL['quality_filter_flags']}) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM f GROUP BY ALL")
def rejection_histogram(spark, d):
    return quality_filter_flags(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT o.o_orderkey AS task_id, count(*) AS actions, count(*) FILTER (l_discount = 0) AS unargued, any_value(o_orderpriority) AS reason, any_value(o_orderstatus) AS status FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1)
 SELECT task_id, greatest(0, CASE WHEN status = 'P' THEN 75 ELSE 100 - 10 * (status = 'O')::INT - 5 * (length(reason) < 20)::INT - 5 * (length(reason || reason || reason) < 30)::INT - 2 * unargued - 5 * (actions < 2)::INT END) / 100 AS score FROM t"""
)
def task_validator_score(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("actions"), F.count_if(F.col("l_discount") == 0).alias("unargued"))
    t = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("task_id"))
    zero = F.lit(0)
    status = lambda s: (F.col("o_orderstatus") == s).cast("int")
    three = F.concat(*["o_orderpriority"] * 3)
    score = validate.task_score(status("P"), zero, zero, status("O"), F.col("o_orderpriority"), three, F.col("actions"), zero, F.col("unargued"), (F.col("actions") >= 2).cast("int"))
    return t.select("task_id", score.alias("score"))


ACTIONS = """a AS (SELECT traj_id, count(*) FILTER (name = 'click') AS searches, min(idx) FILTER (name = 'signup') AS got, min(idx) FILTER (name = 'purchase') AS upd, count(*) FILTER (kind = 'call') AS calls, count(*) AS msgs FROM evt GROUP BY traj_id)"""


@query(
    f"""WITH {ACTIONS} SELECT traj_id, concat_ws(',', CASE WHEN searches > 5 THEN 'too many searches' END, CASE WHEN upd IS NOT NULL AND (got IS NULL OR got >= upd) THEN 'update before get' END,
 CASE WHEN msgs > 35 THEN 'too many messages' END, CASE WHEN calls > 12 THEN 'too many calls' END) AS reasons FROM a""",
    "evt",
)
def action_sequence_valid(spark, d):
    named = F.when(F.col("name") == "click", "search_items").when(F.col("name") == "signup", "get_user").otherwise("update_order")
    rows = event_messages(spark, d)
    calls = rows.groupBy("traj_id").agg(F.count("*").alias("msgs"), F.array_sort(F.collect_list(F.when(F.col("kind") == "call", F.struct("idx", named.alias("n"))))).alias("c"))
    names = F.transform(F.transform("c", lambda c: c["n"]), lambda n: F.when(n == "search_items", "list_things").otherwise(n))
    return calls.select("traj_id", F.array_join(validate.action_sequence_reasons(names, F.col("msgs"), F.lit("airline")), ",").alias("reasons"))


@query(
    """WITH c AS (SELECT *, coalesce(max((name = 'signup')::INT) OVER (PARTITION BY traj_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM evt WHERE kind = 'call')
 SELECT traj_id, idx, event_id FROM c WHERE name = 'purchase' AND seen = 0""",
    "evt",
)
def update_before_get(spark, d):
    calls = event_messages(spark, d).where("kind = 'call'")
    return sequence.update_without_get(calls, F.col("name") == "purchase", F.col("name") == "signup").select("traj_id", F.col("idx").cast("long").alias("idx"), "event_id")


@query(
    """SELECT event_id, 'unknown tool' AS problem FROM evt WHERE kind = 'call' AND name = 'purchase' UNION ALL
 SELECT event_id, 'unknown parameter k' FROM evt WHERE kind = 'call' AND name = 'signup' UNION ALL SELECT event_id, 'missing parameter email' FROM evt WHERE kind = 'call' AND name = 'signup'""",
    "evt",
)
def schema_hallucination_check(spark, d):
    schema = spark.createDataFrame([("click", "k", True), ("click", "note", False), ("signup", "email", True)], "tool string, param string, required boolean")
    calls = event_messages(spark, d).where("kind = 'call'").select("event_id", "name", F.from_json("props", "map<string,string>").alias("arguments"))
    return validate.schema_problems(calls, schema).select("event_id", "problem")


@query("SELECT event_id, name FROM evt WHERE kind = 'call' AND name NOT IN ('click', 'signup')", "evt")
def unknown_tool_anti(spark, d):
    known = spark.createDataFrame([("click",), ("signup",)], "name string")
    return event_messages(spark, d).where("kind = 'call'").join(known, "name", "left_anti").select("event_id", "name")


# --- message text -------------------------------------------------------------------------------------------------


@query("SELECT traj_id, count(*) AS n_messages, string_agg(role || ': ' || content, chr(10) ORDER BY idx) AS transcript FROM conv GROUP BY traj_id", "conv")
def history_transcript(spark, d):
    grouped = conversation_messages(spark, d).groupBy("traj_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    return grouped.select("traj_id", "n_messages", text.transcript(F.col("m")).alias("transcript"))


@query(
    """WITH m AS (SELECT *, min(idx) FILTER (role NOT IN ('system', 'assistant')) OVER (PARTITION BY traj_id) AS f, max(idx) FILTER (role NOT IN ('system', 'user')) OVER (PARTITION BY traj_id) AS l FROM conv)
 SELECT traj_id, idx, role FROM m WHERE NOT (role = 'assistant' AND idx < coalesce(f, 2147483647)) AND NOT (role = 'user' AND idx > coalesce(l, -1))""",
    "conv",
)
def sft_head_tail_trim(spark, d):
    return sequence.trim_ends(conversation_messages(spark, d)).select("traj_id", "idx", "role")


@query(
    """WITH g AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER (PARTITION BY traj_id ORDER BY idx) = 'tool' THEN 0 ELSE 1 END AS s FROM evt),
 h AS (SELECT *, sum(s) OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM g),
 m AS (SELECT traj_id, min(idx) AS idx, arg_min(role, idx) AS role, string_agg(content, '' ORDER BY idx) AS content FROM h GROUP BY traj_id, grp),
 w AS (SELECT *, min(idx) FILTER (role <> 'assistant') OVER (PARTITION BY traj_id) AS f, max(idx) FILTER (role <> 'user') OVER (PARTITION BY traj_id) AS l FROM m)
 SELECT traj_id, idx, role, content FROM w WHERE NOT (role = 'assistant' AND idx < coalesce(f, 2147483647)) AND NOT (role = 'user' AND idx > coalesce(l, -1))""",
    "evt",
)
def sft_merge_tool_results(spark, d):
    rows = event_messages(spark, d).withColumn("user_side", F.lit(False))
    return sequence.merge_tool_results(rows).select("traj_id", F.col("idx").cast("long").alias("idx"), "role", "content")


@query(
    "WITH v AS (SELECT traj_id, arg_max(role, idx) = 'assistant' AS valid FROM conv GROUP BY traj_id) SELECT traj_id, idx, role, content FROM conv JOIN v USING (traj_id) WHERE valid AND role IN ('system', 'user', 'assistant')",
    "conv",
)
def sft_project(spark, d):
    """Messages of the conversations that end with an answer."""
    rows = conversation_messages(spark, d)
    verdicts = rows.groupBy("traj_id").agg((F.max_by("role", "idx") == "assistant").alias("valid"))
    return rows.join(verdicts, "traj_id").where(F.coalesce("valid", F.lit(True)) & F.col("role").isin("system", "user", "assistant")).select("traj_id", "idx", "role", "content")


@query(
    """WITH o AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY traj_id ORDER BY idx) = 1 AND role <> 'system') OR coalesce(trim(content), '') = '' THEN 1 END AS why FROM conv),
 v AS (SELECT *, count(why) OVER (PARTITION BY traj_id) = 0 AS valid FROM o) SELECT traj_id, idx, role, content FROM v WHERE valid AND role IN ('system', 'user', 'assistant')""",
    "conv",
)
def sft_project_valid(spark, d):
    """Messages of the conversations that the validator passes; one without a verdict counts as valid."""
    rows = conversation_messages(spark, d)
    verdicts = role_sequence_valid(spark, d).select("traj_id", "valid")
    joined = rows.join(verdicts, "traj_id", "left")
    return joined.where(F.coalesce("valid", F.lit(True)) & F.col("role").isin("system", "user", "assistant")).select("traj_id", "idx", "role", "content")


@query("SELECT event_id, name AS call_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM evt WHERE kind = 'call'", "evt")
def tool_call_extract_first(spark, d):
    call = text.first_tool_call(F.col("content"))
    rows = event_messages(spark, d).withColumn("call", call).where("call is not null")
    return rows.select("event_id", F.col("call.name").alias("call_name"), F.get_json_object("call.arguments", "$.k").cast("long").alias("k"))


@query("SELECT traj_id, count(*) AS n_calls, string_agg(name, ',' ORDER BY idx) AS names FROM evt WHERE kind = 'call' GROUP BY traj_id", "evt")
def tool_call_extract_all(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda m: m["content"]), "\n")
    whole = event_messages(spark, d).groupBy("traj_id").agg(joined.alias("content"))
    calls = text.all_tool_calls(F.col("content"))
    return whole.select("traj_id", F.size(calls).cast("long").alias("n_calls"), F.array_join(F.transform(calls, lambda c: c["name"]), ",").alias("names"))


@query("SELECT event_id, content AS rendered FROM evt WHERE kind = 'call'", "evt")
def tool_call_roundtrip(spark, d):
    rows = event_messages(spark, d).where("kind = 'call'").withColumn("call", text.first_tool_call(F.col("content")))
    return rows.select("event_id", text.render_tool_call(F.col("call.name"), F.regexp_replace("call.arguments", '":', '": ')).alias("rendered"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace('a' || chr(10) || chr(10) || text, '(?s)<think>.*?</think>', '', 'g'), '(?s)<thinking>.*?</thinking>', '', 'g'), '(?s)<thought>.*?</thought>', '', 'g') || chr(10) || chr(10) || 'b', '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned
 FROM documents"""
)
def strip_think_and_squeeze(spark, d):
    """The whole text of every document."""
    raw = F.concat(F.lit("  a\n\n"), F.lit("<think>plan\n\n</think>"), F.col("text"), F.lit("\n\n<thought>x</thought>b \n"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.remove_think_tags(raw)).alias("cleaned"))


@query(
    """SELECT event_id, is_error AS strict_error, is_error OR content LIKE '%Error:%' AS any_error, regexp_matches(lower(content), 'error|not found|invalid|failed|does not exist|no such|cannot|unable to|exception') AS word_error FROM evt""",
    "evt",
)
def error_predicates(spark, d):
    c = F.col("content")
    return event_messages(spark, d).select("event_id", text.is_error_result(c).alias("strict_error"), text.contains_error(c).alias("any_error"), text.has_error_word(c).alias("word_error"))


TEMPLATED = """t AS (SELECT event_id, name, 'Error: order #W' || event_id || ' of user_x_' || traj_id || ' on 2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || ' cost ' || (event_id % 50) || ' not found' AS message FROM evt WHERE kind = 'result'),
 u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '\\b[a-z]+_[a-z]+_\\d+\\b', '{user_id}', 'g'), '#W\\d+', '{order_id}', 'g'), '\\d{4}-\\d{2}-\\d{2}', '{date}', 'g'), '\\b\\d+\\b', '{amount}', 'g') AS error FROM t)""".replace("\\\\", "\\")


def _failures(spark, d):
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    message = F.concat(F.lit("Error: order #W"), F.col("event_id").cast("string"), F.lit(" of user_x_"), F.col("traj_id").cast("string"), F.lit(" on 2024-01-"), day, F.lit(" cost "), (F.col("event_id") % 50).cast("string"), F.lit(" not found"))
    return event_messages(spark, d).where("kind = 'result'").select("event_id", "name", "traj_id", message.alias("message"))


@query(f"WITH {TEMPLATED} SELECT event_id, error FROM u", "evt")
def error_template(spark, d):
    return _failures(spark, d).select("event_id", text.error_template(F.col("message")).alias("error"))


@query(
    f"""WITH {TEMPLATED}, r AS (SELECT *, row_number() OVER (PARTITION BY name, error ORDER BY event_id) AS place FROM u)
 SELECT 'shop' AS domain, name AS tool, error, count(*) AS count, string_agg(message, '|' ORDER BY event_id) FILTER (place <= 3) AS examples FROM r GROUP BY name, error""",
    "evt",
)
def error_db_build(spark, d):
    rows = _failures(spark, d).select(F.lit("shop").alias("domain"), F.col("name").alias("tool"), "message", F.col("event_id").alias("seq"))
    return errors.build_error_db(rows, 3).withColumn("examples", F.array_join("examples", "|"))


@query(f"WITH {TEMPLATED} SELECT 'shop' AS domain, name AS tool, error, message AS example, min(event_id) AS first_seq, count(*) AS n FROM u GROUP BY name, error, message", "evt")
def error_db_examples(spark, d):
    rows = _failures(spark, d).select(F.lit("shop").alias("domain"), F.col("name").alias("tool"), "message", F.col("event_id").alias("seq"))
    return errors.error_examples(rows)


@query(f"WITH {TEMPLATED}, g AS (SELECT name, error, count(*) AS n FROM u GROUP BY name, error) SELECT 'shop' AS domain, count(DISTINCT name) AS n_tools, count(*) AS n_errors, CAST(sum(n) AS BIGINT) AS total FROM g", "evt")
def error_db_stats(spark, d):
    rows = _failures(spark, d).select(F.lit("shop").alias("domain"), F.col("name").alias("tool"), "message", F.col("event_id").alias("seq"))
    return errors.error_db_stats(errors.error_counts(rows))


#: Messages of the recoverable and the other kinds, and some of neither: (message, recoverable).
MESSAGES = (
    ("Missing 1 required positional argument: 'user_id'", True), ("got an unexpected keyword argument 'x'", True), ("1 validation error for Order", True), ("Invalid date format", True), ("the status should be pending", True),
    ("Payment amount does not add up, total price is 5", True), ("Number of passengers does not match", True), ("the items should match", True), ("Balance is not enough", True), ("Insufficient funds", True),
    ("validation error: item not found", False), ("User does not exist", False), ("Tool get_x not found", False), ("order cannot be cancelled", False), ("service is down", False), ("", False),
)


@query(f"SELECT event_id, event_id % {len(MESSAGES)} IN ({', '.join(str(k) for k, (_, good) in enumerate(MESSAGES) if good)}) AS recoverable FROM evt", "evt")
def recoverable_error_filter(spark, d):
    """Every allowed and every denied pattern, denied ones beside allowed ones, and texts of neither kind."""
    message = F.get(F.array(*[F.lit(m) for m, _ in MESSAGES]), (F.col("event_id") % len(MESSAGES)).cast("int"))
    return event_messages(spark, d).select("event_id", text.is_recoverable(message).alias("recoverable"))


@query("SELECT doc_id, len(list_filter(string_split(text, '.'), lambda s: trim(s, ' ') <> '')) > 5 OR length(text) > 300 AS too_long, len(list_filter(string_split(text, '.'), lambda s: trim(s, ' ') <> '')) > 5 AS many_sentences, length(text) > 300 AS long FROM documents")
def user_reply_rules(spark, d):
    """The verdict for every document, and each of the two rules."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.reply_too_long(c).alias("too_long"), (text.sentence_count(c) > 5).alias("many_sentences"), (F.length(c) > 300).alias("long"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (len(list_filter(string_split(text, '.'), lambda s: trim(s, ' ') <> '')) > 5) AS many_sentences, count(*) FILTER (length(text) > 300) AS long FROM documents GROUP BY lang")
def user_reply_rule_counts(spark, d):
    """How many texts of each language break each of the two rules."""
    c = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.sentence_count(c) > 5).alias("many_sentences"), F.count_if(F.length(c) > 300).alias("long"))


@query("SELECT doc_id, len(list_filter(string_split(text, '.'), lambda s: trim(s, ' ') <> '')) > 5 OR length(text) > 300 AS too_long FROM documents")
def user_reply_rules_all(spark, d):
    """A verdict for every document, whatever its language."""
    return table(spark, d, "documents").select("doc_id", text.reply_too_long(F.col("text")).alias("too_long"))


# --- injection and pruning ------------------------------------------------------------------------------------------

POINTS = "p AS (SELECT * FROM (SELECT *, lead(role) OVER (PARTITION BY traj_id ORDER BY idx) AS nr, lead(is_error) OVER (PARTITION BY traj_id ORDER BY idx) AS ne FROM (SELECT * REPLACE (CASE WHEN kind = 'text' THEN 'tool' ELSE role END AS role) FROM evt)) WHERE kind = 'call' AND nr = 'tool' AND NOT ne)"
PICKED = """c AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY md5(traj_id || ':' || idx || ':7'), idx) AS rk, CAST('0x' || substring(md5(traj_id || ':' || idx || ':8'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p),
 k AS (SELECT * FROM c WHERE rk <= 3 AND u < 0.6)"""


def _points(spark, d):
    """Texts count as tool results here, so that calls have answers without an error."""
    rows = event_messages(spark, d).withColumn("role", F.when(F.col("kind") == "text", "tool").otherwise(F.col("role")))
    return rows.withColumn("call_name", text.first_tool_call(F.col("content"))["name"])


@query(f"WITH {POINTS} SELECT traj_id, idx, name FROM p", "evt")
def injection_points(spark, d):
    return inject.injection_points(_points(spark, d)).select("traj_id", F.col("idx").cast("long").alias("idx"), "name")


@query(f"WITH {POINTS}, {PICKED} SELECT traj_id, count(*) AS n_errors FROM k GROUP BY traj_id", "evt")
def inject_counts(spark, d):
    return inject.choose_points(inject.injection_points(_points(spark, d)), 3, 0.6, 7).groupBy("traj_id").agg(F.count("*").alias("n_errors"))


@query(
    f"""WITH {POINTS}, {PICKED}, s AS (SELECT e.traj_id, e.idx, part, CASE WHEN k.idx IS NULL THEN CASE WHEN e.kind = 'text' THEN 'tool' ELSE e.role END WHEN part = 1 THEN 'tool' ELSE 'assistant' END AS role,
 CASE WHEN k.idx IS NULL OR part = 2 THEN e.content WHEN part = 1 THEN 'Error: bad ' || e.name ELSE 'wrong ' || e.name END AS content
 FROM evt e LEFT JOIN k ON k.traj_id = e.traj_id AND k.idx = e.idx, (VALUES (0), (1), (2)) v(part) WHERE part = 0 OR k.idx IS NOT NULL)
 SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY idx, part) - 1 AS idx, role, content FROM s""",
    "evt",
)
def inject_splice(spark, d):
    rows = _points(spark, d)
    chosen = inject.choose_points(inject.injection_points(rows), 3, 0.6, 7)
    errors_of = chosen.select("traj_id", "idx", F.concat(F.lit("wrong "), "name").alias("wrong"), F.concat(F.lit("Error: bad "), "name").alias("error"), F.col("content").alias("recovery"))
    return inject.splice(rows, errors_of).select("traj_id", F.col("idx").cast("long").alias("idx"), "role", "content")


@query(
    """WITH c AS (SELECT traj_id, list_reduce(list_prepend(0, list((event_id % 3 = 0)::INT ORDER BY idx)), lambda a, x: CASE WHEN x = 1 AND a // 10 < 8 AND a % 10 < 2 THEN (a // 10 + 1) * 10 + a % 10 + 1 ELSE (a // 10) * 10 END) AS a FROM evt WHERE kind = 'call' GROUP BY traj_id)
 SELECT traj_id, a // 10 AS n_injected FROM c""",
    "evt",
)
def online_injection_fold(spark, d):
    calls = event_messages(spark, d).where("kind = 'call'").groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", (F.col("event_id") % 3 == 0).alias("w")))), lambda c: c["w"]).alias("w"))
    made = inject.online_injection(F.col("w"), 8, 2)
    return calls.select("traj_id", F.size(F.filter(made, lambda x: x)).alias("n_injected"))


@query(
    """SELECT c.traj_id, c.idx, c.role, CASE WHEN c.idx = 3 AND c.traj_id % 2 = 0 THEN 'fixed' ELSE c.content END AS content FROM conv c WHERE NOT (c.traj_id % 2 = 0 AND c.idx >= 1 AND c.idx < 3)""",
    "conv",
)
def prune_segments(spark, d):
    rows = conversation_messages(spark, d)
    segments = rows.where("traj_id % 2 = 0 AND idx = 1").select("traj_id", F.col("idx").alias("start_idx"), F.lit(3).cast("long").alias("fix_idx"), F.lit("fixed").alias("corrected"))
    return inject.prune_segments(rows, segments)


@query(
    """WITH v AS (SELECT doc_id % 200 AS segment_id, doc_id // 200 % 2 + 1 AS round, quality = 1 AS yes FROM labels), r AS (SELECT segment_id, round, count(*) AS n, count(*) FILTER (yes) AS y FROM v GROUP BY ALL),
 u AS (SELECT segment_id, arg_min(y > 0, round) FILTER (y = 0 OR y = n) AS p, min(round) FILTER (y = 0 OR y = n) AS rd, arg_max(2 * y > n, round) AS lp, max(round) AS lr FROM r GROUP BY segment_id)
 SELECT segment_id, coalesce(p, lp) AS prune, coalesce(rd, lr) AS decided_round FROM u"""
)
def vote_decision(spark, d):
    votes = table(spark, d, "labels").select((F.col("doc_id") % 200).alias("segment_id"), (F.floor(F.col("doc_id") / 200) % 2 + 1).alias("round"), F.col("doc_id").alias("agent_id"), (F.col("quality") == 1).alias("should_prune"))
    return inject.vote_decisions(votes)


@query(
    """WITH x AS (SELECT traj_id, max(idx) FILTER (kind = 'call') AS l FROM evt GROUP BY traj_id) SELECT traj_id, l + 1 AS kept FROM x WHERE l IS NOT NULL""",
    "evt",
)
def truncate_at_last_call(spark, d):
    m = event_messages(spark, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", (F.col("kind") == "call").alias("has_call")))).alias("m"))
    return m.select("traj_id", F.size(sequence.truncate_at_last_call(F.col("m"))).cast("long").alias("kept")).where("kept is not null")


@query(
    """SELECT traj_id, string_agg(role || '=' || left(content, 200), ';' ORDER BY idx) AS context FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY idx DESC) AS back FROM conv) WHERE back <= 3 GROUP BY traj_id""",
    "conv",
)
def context_last_k(spark, d):
    """The last three messages of each conversation, with the operator's own 200 characters a message."""
    m = conversation_messages(spark, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    return m.select("traj_id", F.array_join(F.transform(text.context_tail(F.col("m"), 3), lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";").alias("context"))


@query(
    """SELECT traj_id, string_agg(role || '=' || left(content, 200), ';' ORDER BY idx) AS context FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY idx DESC) AS back FROM evt) WHERE back <= 6 GROUP BY traj_id""",
    "evt",
)
def context_last_k_whole(spark, d):
    """With the operator's own 200 characters a message, so that calls keep their name and arguments."""
    m = event_messages(spark, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    return m.select("traj_id", F.array_join(F.transform(text.context_tail(F.col("m")), lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";").alias("context"))


@query(
    """WITH e AS (SELECT traj_id, idx FROM evt WHERE is_error) SELECT e.traj_id, e.idx AS mark_idx, coalesce(min(m.idx), -1) AS first_idx FROM e LEFT JOIN evt m ON m.traj_id = e.traj_id AND m.idx > e.idx AND m.role = 'assistant' GROUP BY ALL""",
    "evt",
)
def first_answer_after_error(spark, d):
    rows = event_messages(spark, d)
    out = sequence.first_after(rows, rows.where("is_error").select("traj_id", F.col("idx").alias("mark_idx")), F.col("role") == "assistant")
    return out.select("traj_id", F.col("mark_idx").cast("long").alias("mark_idx"), F.coalesce(F.col("first_idx").cast("long"), F.lit(-1).cast("long")).alias("first_idx"))


# --- joins ----------------------------------------------------------------------------------------------------------

ATTEMPTS = "a AS (SELECT source || '-' || domain AS task, row_number() OVER (PARTITION BY source, domain ORDER BY task_id) AS attempt, reward FROM lab)"


def _attempts(spark, d):
    w = Window.partitionBy("source", "domain").orderBy("task_id")
    return labelled_runs(spark, d).select(F.concat_ws("-", "source", "domain").alias("task"), F.row_number().over(w).cast("long").alias("attempt"), "reward")


@query(f"WITH {ATTEMPTS}, l AS (SELECT task, max(attempt) AS last FROM a GROUP BY task), s AS (SELECT a.* FROM a JOIN l ON a.task = l.task AND a.attempt = l.last WHERE a.reward <> 0) SELECT f.task, f.attempt AS failed, s.attempt AS succeeded FROM a f JOIN s ON f.task = s.task WHERE f.reward = 0 AND f.attempt < s.attempt", "lab")
def contrast_pairs(spark, d):
    rows = _attempts(spark, d)
    last = rows.groupBy("task").agg(F.max_by(F.struct("attempt", "reward"), "attempt").alias("s")).where(F.col("s.reward") != 0)
    return rows.where("reward = 0").join(last, "task").where(F.col("attempt") < F.col("s.attempt")).select("task", F.col("attempt").alias("failed"), F.col("s.attempt").alias("succeeded"))


@query(f"WITH {ATTEMPTS} SELECT task, max(attempt) AS attempt, arg_max(reward, attempt) AS reward FROM a GROUP BY task", "lab")
def last_attempt_success(spark, d):
    return _attempts(spark, d).groupBy("task").agg(F.max("attempt").alias("attempt"), F.max_by("reward", "attempt").alias("reward"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH keys AS (SELECT CAST(task_id AS VARCHAR) AS key, task_id, 0 AS prio FROM lab UNION ALL SELECT CAST(row_number() OVER (ORDER BY task_id) - 1 AS VARCHAR), task_id, 1 FROM lab),
 k AS (SELECT key, arg_max(task_id, prio) AS task_id FROM keys GROUP BY key) SELECT c.conv_id, k.task_id FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.key = CAST(c.conv_id AS VARCHAR)""",
    "lab",
)
def simulation_task_dual_key(spark, d):
    tasks = labelled_runs(spark, d).select("task_id")
    places = numbered(tasks, ["task_id"], "place").select(F.col("place").cast("string").alias("key"), "task_id", F.lit(1).alias("prio"))
    keys = tasks.select(F.col("task_id").cast("string").alias("key"), "task_id", F.lit(0).alias("prio")).unionByName(places)
    chosen = keys.groupBy("key").agg(F.max_by("task_id", "prio").alias("task_id"))
    sims = table(spark, d, "conversations").select("conv_id").distinct()
    return sims.join(chosen, sims["conv_id"].cast("string") == chosen["key"], "left").select("conv_id", "task_id")


@query("SELECT lang AS domain, doc_id % 50 AS task, count(DISTINCT source) AS n_models, string_agg(source || ':' || doc_id, ',' ORDER BY source, doc_id) AS responses FROM documents GROUP BY ALL")
def cogroup_responses(spark, d):
    """All responses of a task in order, and how many models gave them; a row is as long as its list."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("domain"), (F.col("doc_id") % 50).alias("task"), "source", "doc_id")
    of_model = docs.groupBy("domain", "task", "source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    told = of_model.select("domain", "task", "source", F.array_join(F.transform("ids", lambda k: F.concat(F.col("source"), F.lit(":"), k.cast("string"))), ",").alias("part"))
    models = told.groupBy("domain", "task").agg(F.count("source").alias("n_models"), F.array_sort(F.collect_list(F.struct("source", "part"))).alias("parts"))
    lists = F.filter(F.transform("parts", lambda p: p["part"]), lambda p: p != "")
    return models.select("domain", "task", "n_models", F.when(F.size(lists) > 0, F.array_join(lists, ",")).alias("responses"))


@query(
    """WITH r AS (SELECT lang AS domain, doc_id % 50 AS task, source, doc_id, (row_number() OVER (PARTITION BY lang, doc_id % 50 ORDER BY source, doc_id) - 1) // 16 AS chunk FROM documents)
 SELECT domain, task, chunk, count(DISTINCT source) AS n_models, string_agg(source || ':' || doc_id, ',' ORDER BY source, doc_id) AS responses FROM r GROUP BY ALL"""
)
def cogroup_response_chunks(spark, d):
    """Responses of a task in lists of at most 16, however many there are."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("domain"), (F.col("doc_id") % 50).alias("task"), "source", "doc_id")
    chunks = reports.response_chunks(docs, ["domain", "task"], ["source", "doc_id"], 16)
    told = F.array_join(F.transform("responses", lambda r: F.concat_ws(":", r["source"], r["doc_id"].cast("string"))), ",")
    return chunks.select("domain", "task", "chunk", F.size(F.array_distinct(F.transform("responses", lambda r: r["source"]))).cast("long").alias("n_models"), told.alias("responses"))


@query("SELECT p_partkey, 'Dear {customer}, ' || p_name || ' of ' || p_brand || ' costs {price}' AS filled FROM part")
def template_fill(spark, d):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.fill_template(F.lit("Dear {customer}, {name} of {brand} costs {price}"), values).alias("filled"))


@query("SELECT s_suppkey, 'city=' || n_name || ';name=' || s_name AS args FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def param_substitute(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, d, "supplier").join(nations, "s_nationkey", "left")
    args = F.transform_values(F.create_map(F.lit("city"), F.lit("<CITY>"), F.lit("name"), F.col("s_name")), lambda k, v: F.coalesce(F.element_at(F.create_map(F.lit("city"), F.col("n_name")), k), v))
    return rows.select("s_suppkey", F.array_join(F.transform(F.map_entries(args), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("args"))


@query("SELECT c.c_custkey, coalesce(o.last_order, g.o) AS order_key FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey, (SELECT min(o_orderkey) AS o FROM orders) g")
def own_orders_or_any(spark, d):
    orders = table(spark, d, "orders")
    own = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    first = orders.agg(F.min("o_orderkey").alias("o"))  # one row
    return table(spark, d, "customer").select("c_custkey").join(own, "c_custkey", "left").crossJoin(F.broadcast(first)).select("c_custkey", F.coalesce("last_order", "o").alias("order_key"))


# --- reports and statistics ------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT name, count(*) FILTER (NOT called AND discount < 5) AS missing, count(*) FILTER (NOT called AND discount >= 5) AS wrong_params FROM ord GROUP BY name) SELECT name AS action, missing, wrong_params FROM c ORDER BY missing DESC, name LIMIT 10""",
    "ord",
)
def missing_wrong_topk(spark, d):
    checks = order_actions(spark, d).select(F.lit("all").alias("domain"), F.col("name").alias("action"), F.col("called").cast("double").alias("score"), (F.col("discount") >= 5).alias("found"))
    return metrics.failure_counts(checks).orderBy(F.desc("missing"), "action").limit(10).select("action", "missing", "wrong_params")


@query("SELECT lang AS domain, source AS termination, count(*) AS n FROM documents GROUP BY ALL")
def termination_histogram(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("domain"), F.col("source").alias("termination")).agg(F.count("*").alias("n"))


@query("SELECT domain, task_id, rn AS rank FROM (SELECT domain, task_id, row_number() OVER (PARTITION BY domain ORDER BY task_id) AS rn FROM lab WHERE reward = 0) WHERE rn <= 10", "lab")
def failure_report_rows(spark, d):
    failed = labelled_runs(spark, d).where("reward = 0").withColumn("order", -F.col("task_id"))
    return metrics.top_per_key(failed, "domain", "order", "source", 10).select("domain", "task_id", F.col("rank").cast("long").alias("rank"))


@query("WITH p AS (SELECT task_id, string_agg(name, '>' ORDER BY name, quantity, discount) AS pattern FROM ord GROUP BY task_id) SELECT pattern, count(*) AS n, count(*) / sum(count(*)) OVER () AS frequency FROM p GROUP BY pattern", "ord")
def pattern_distributions(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("name", "quantity", "discount")))
    p = order_actions(spark, d).groupBy("task_id").agg(F.array_join(F.transform(ordered, lambda c: c["name"]), ">").alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("frequency", F.col("n") / F.lit(p.count()))


@query("SELECT 'brand' AS param, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment")
def param_histograms(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    pair = lambda name, c: F.struct(F.lit(name).alias("param"), c.alias("value"))
    both = part.select(F.explode(F.array(pair("brand", F.col("p_brand")), pair("size", F.col("p_size").cast("string")))).alias("p")).unionByName(customer.select(pair("segment", F.col("c_mktsegment")).alias("p")))
    return both.select("p.*").where("value is not null AND value <> ''").groupBy("param", "value").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def table_cardinalities(spark, d):
    out = None
    for name in ("customer", "orders", "part", "supplier"):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_mktsegment AS segment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 10")
def first_n_samples(spark, d):
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return table(spark, d, "customer").withColumn("rn", rank).where("rn <= 10").select(F.col("c_mktsegment").alias("segment"), "c_custkey")


@query(
    """SELECT role AS component, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, round(sum(length(content) // 4) * 3.0 / 1000000, 9) AS cost, round(sum(length(content) // 4) * 100.0 / sum(sum(length(content) // 4)) OVER (), 9) AS percent FROM conv GROUP BY role""",
    "conv",
)
def token_cost_breakdown(spark, d):
    g = conversation_messages(spark, d).groupBy(F.col("role").alias("component")).agg(F.sum(F.floor(F.length("content") / 4)).alias("tokens"))
    return g.select("component", "tokens", F.round(F.col("tokens") * 3.0 / 1000000, 9).alias("cost"), F.round(F.col("tokens") * 100.0 / F.sum("tokens").over(Window.partitionBy(F.lit(1))), 9).alias("percent"))


@query(
    """SELECT source, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS counted, CAST(sum(doc_id % 4) AS BIGINT) AS corrections, round(CASE WHEN sum(n_chars) = 0 THEN 0 ELSE sum(doc_id % 4) / sum(n_chars) END, 12) AS rate FROM documents GROUP BY source"""
)
def synthetic_run_aggregate(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("records"), F.sum("n_chars").alias("counted"), F.sum(F.col("doc_id") % 4).alias("corrections"))
    return g.withColumn("rate", F.round(scoring.ratio(F.col("corrections"), F.col("counted"), 0.0), 12))


@query("SELECT domain, is_error AS skipped, count(*) AS n FROM lab GROUP BY ALL", "lab")
def conversion_stats(spark, d):
    return labelled_runs(spark, d).groupBy("domain", F.col("is_error").alias("skipped")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM lab GROUP BY source", "lab")
def merge_stats(spark, d):
    g = labelled_runs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("SELECT count(DISTINCT source) AS n_models, count(DISTINCT lang) AS n_domains, count(*) AS n_trajectories FROM documents")
def extraction_summary(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("n_models"), F.countDistinct("lang").alias("n_domains"), F.count("*").alias("n_trajectories"))


# --- sampling ---------------------------------------------------------------------------------------------------------


@query("SELECT task_id FROM lab ORDER BY md5(task_id || ':42'), task_id LIMIT 100", "lab")
def uniform_sample(spark, d):
    return sampling.sample_without_replacement(labelled_runs(spark, d).select("task_id"), 100, "task_id", 42)


@query(
    """WITH w AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) AS hi, p_size, sum(p_size) OVER () AS total FROM part), u AS (SELECT i AS draw, CAST('0x' || substring(md5(i || ':5'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(500) t(i))
 SELECT u.draw, w.p_partkey FROM u JOIN w ON u.u >= (w.hi - w.p_size) / w.total AND u.u < w.hi / w.total"""
)
def weighted_sample_with_replacement(spark, d):
    return sampling.sample_with_replacement(table(spark, d, "part").select("p_partkey", "p_size"), 500, "p_size", "p_partkey", 5).select("draw", "p_partkey")


@query(
    """WITH r AS (SELECT task_id FROM lab WHERE domain = 'en'), s AS (SELECT task_id FROM lab WHERE domain <> 'en'), n AS (SELECT (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM s) AS s)
 SELECT 'real' AS side, task_id FROM (SELECT task_id, row_number() OVER (ORDER BY md5(task_id || ':3'), task_id) AS k FROM r), n WHERE k <= least(CAST(floor((n.r + n.s) * 0.3) AS BIGINT), n.r)
 UNION ALL SELECT 'synthetic', task_id FROM (SELECT task_id, row_number() OVER (ORDER BY md5(task_id || ':3'), task_id) AS k FROM s), n WHERE k <= least(CAST(floor((n.r + n.s) * 0.7) AS BIGINT), n.s)""",
    "lab",
)
def ratio_merge(spark, d):
    rows = labelled_runs(spark, d)
    real = rows.where("domain = 'en'").select(F.lit("real").alias("side"), "task_id")
    synthetic = rows.where("domain <> 'en'").select(F.lit("synthetic").alias("side"), "task_id")
    return sampling.ratio_merge(real, synthetic, 0.3, "task_id", 3)


@query("WITH r AS (SELECT task_id, row_number() OVER (ORDER BY md5(task_id || ':42'), task_id) AS k FROM lab) SELECT scale, task_id FROM r, (VALUES (20), (50), (100), (200)) s(scale) WHERE k <= scale AND scale <= (SELECT count(*) FROM lab)", "lab")
def scaling_subsets(spark, d):
    return sampling.scaling_subsets(labelled_runs(spark, d).select("task_id"), (20, 50, 100, 200, 10**12), "task_id", 42)


@query("SELECT domain, task_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(task_id || ':9'), task_id) AS k FROM lab) WHERE (domain = 'en' AND k <= 30) OR (domain = 'fr' AND k <= 10)", "lab")
def stratified_configs(spark, d):
    return sampling.stratified_sample(labelled_runs(spark, d), "domain", {"en": 30, "fr": 10}, "task_id", 9).select("domain", "task_id")


@query("SELECT n_nationkey, 103 // 25 + (row_number() OVER (ORDER BY n_nationkey) <= 103 % 25)::INT AS allocated FROM nation")
def proportional_alloc(spark, d):
    return sampling.proportional_allocation(table(spark, d, "nation").select("n_nationkey"), 103, "n_nationkey")


@query("SELECT task_id, copy FROM lab, range(1, 4) r(copy) WHERE copy <= task_id % 4", "lab")
def repeat_by_weight(spark, d):
    out = sampling.repeat_by_weight(labelled_runs(spark, d).select("task_id"), F.col("task_id") % 4)
    return out.select("task_id", F.col("copy").cast("long").alias("copy"))


@query("SELECT task_id, 1 + CAST(floor(CAST('0x' || substring(md5(task_id || ':2'), 1, 8) AS BIGINT) / 4294967296.0 * 3) AS INTEGER) AS n_errors FROM lab WHERE CAST('0x' || substring(md5(task_id || ':1'), 1, 8) AS BIGINT) / 4294967296.0 < 0.4", "lab")
def bernoulli_error_gate(spark, d):
    return sampling.bernoulli(labelled_runs(spark, d).select("task_id"), 0.4, "task_id", 1).select("task_id", sampling.error_count("task_id", 3, 2).alias("n_errors"))


@query("SELECT 'full' AS dataset, count(*) AS n FROM lab UNION ALL SELECT 'no_errors', count(*) FROM lab WHERE NOT is_error UNION ALL SELECT 'only_success', count(*) FROM lab WHERE NOT is_error AND reward > 0", "lab")
def experiment_datasets(spark, d):
    rows = labelled_runs(spark, d).select("task_id", "reward", "is_error")
    parts = {"good": rows.where("NOT is_error AND reward > 0"), "weak": rows.where("NOT is_error AND reward <= 0"), "errors": rows.where("is_error")}
    mix = sampling.experiment_mix(parts, {"full": ("good", "weak", "errors"), "no_errors": ("good", "weak"), "only_success": ("good",)})
    return mix.groupBy("dataset").agg(F.count("*").alias("n"))


# --- streams replayed as tables, generation -----------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1")
def tumbling_error_rate(spark, d):
    from trajlake.streaming.jobs import tumbling_error_rate as windows

    return windows(table(spark, d, "events"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM h GROUP BY user_id, k"""
)
def session_trajectories(spark, d):
    from trajlake.streaming.jobs import sessions

    return sessions(table(spark, d, "events"))


@query("SELECT source AS task_id, count(*) AS attempts, count(*) FILTER (reward <= 0) AS failures, count(*) FILTER (reward <= 0) / count(*) AS fail_rate FROM lab GROUP BY source", "lab")
def stateful_failure_history(spark, d):
    from trajlake.streaming.jobs import failure_history as history

    return history(labelled_runs(spark, d).select(F.col("source").alias("task_id"), "reward"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'A required parameter was missing; I will include it and retry.' WHEN event_id % 3 = 1 THEN 'The input was not valid; I will correct its format and retry.'
 ELSE 'The balance did not suffice; I will check the payment method and retry.' END AS recovery FROM evt WHERE kind = 'result'""",
    "evt",
)
def llm_recovery_stub(spark, d):
    kind = F.col("event_id") % 3
    message = F.when(kind == 0, "missing required argument").when(kind == 1, "invalid date").otherwise("insufficient funds")
    return event_messages(spark, d).where("kind = 'result'").select("event_id", inject.recovery_thought(message).alias("recovery"))


@query("SELECT conv_id AS traj_id, 'Analyse:' AS summary, CAST(length(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) + 9 AS INTEGER) AS length FROM conversations GROUP BY conv_id")
def analysis_rows_stub(spark, d):
    from trajlake.operators.provider import RuleProvider, analysis_rows, parsed_answer

    grouped = conversation_messages(spark, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    rows = analysis_rows(grouped.select("traj_id", text.transcript(F.col("m")).alias("transcript")), RuleProvider())
    answer = parsed_answer(F.col("messages")[1]["content"], "summary string, length int")
    return rows.select("traj_id", answer["summary"].alias("summary"), answer["length"].alias("length"))


@query("SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN -10 WHEN 2 THEN 50 WHEN 3 THEN -50 WHEN 4 THEN 100 ELSE -100 END AS VARCHAR) AS wrong FROM evt WHERE kind = 'call'", "evt")
def value_corruption(spark, d):
    return event_messages(spark, d).where("kind = 'call'").select("event_id", inject.corrupt_text(F.get_json_object("props", "$.k"), F.col("event_id")).alias("wrong"))


@query("SELECT p_brand AS brand, CAST(p_size AS VARCHAR) AS size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 3")
def parameter_pairs(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size")).agg(F.count("*").alias("n")).where("n >= 3")


from trajlake.plans import checks, formats, jobs, surface  # noqa: E402, F401  they register their queries beside these
