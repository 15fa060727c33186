"""Evaluation metrics of runs and their roll-ups.

Every trajectory metric is a narrow projection over the trajectory's own arrays; each roll-up is one grouped
aggregation with partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.matching import parameter_score
from trajlake.functions.text import has_error_word

METRICS = ("tool_call_accuracy", "parameter_accuracy", "conversation_efficiency", "error_recovery_rate")


def effective_reward(reward: Column, inner_reward: Column) -> Column:
    """The top-level reward unless it is null or zero; then the inner one."""
    return F.when(F.coalesce(reward, F.lit(0.0)) != 0, reward).otherwise(inner_reward)


def agent_actions(actions: Column) -> Column:
    """Expected actions that are the agent's: those of the user side are left out, an unknown side stays."""
    return F.filter(actions, lambda a: F.coalesce(a["requestor"], F.lit("")) != "user")


def simulation_metrics(sims: DataFrame, score: Callable[[Column, Column], Column] = parameter_score) -> DataFrame:
    """Adds the metrics of a simulation.

    Needs: reward double; expected array<struct<name, arguments>>; calls array<struct<name, arguments>>, arguments being
    maps of texts, or whatever ``score`` compares (``json_parameter_score``: JSON text);
    results array<string> in order; n_messages (assistant and user); expected_turns.  Ratios without a denominator are
    null inside the engine (``at_edge`` turns them into -1).
    """
    best = F.transform(
        "expected",
        lambda e: F.array_max(F.transform(F.filter("calls", lambda c: c["name"] == e["name"]), lambda c: score(e["arguments"], c["arguments"]))),
    )
    errors = F.transform("results", lambda r, i: F.struct(has_error_word(r).alias("bad"), (i < F.size("results") - 1).alias("inner")))
    success = F.coalesce(F.col("reward") > 0, F.lit(False))
    n_expected = F.size("expected")
    turns = F.when(F.coalesce(F.col("expected_turns"), F.lit(0)) > 0, F.col("expected_turns")).otherwise(F.greatest(2 * n_expected, F.lit(2)))
    step = sims.withColumns({"_best": best, "_errors": errors, "success": success, "n_expected": n_expected, "turns_expected": turns})
    matched = F.size(F.filter("_best", lambda b: b.isNotNull()))
    n_errors = F.size(F.filter("_errors", lambda e: e["bad"]))
    recovered = F.when(F.col("success"), F.size(F.filter("_errors", lambda e: e["bad"] & e["inner"]))).otherwise(0)
    total = F.aggregate("_best", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return step.withColumns(
        {
            "n_matched": matched,
            "n_errors": n_errors,
            "n_recovered": recovered,
            "tool_call_accuracy": F.try_divide(matched, n_expected),
            "parameter_accuracy": F.try_divide(total, n_expected),
            "conversation_efficiency": F.when(F.col("n_messages") == 0, 0.0).otherwise(F.least(F.col("turns_expected") / F.col("n_messages"), F.lit(1.0))),
            "error_recovery_rate": F.when(n_errors == 0, 1.0).otherwise(recovered / n_errors),
        }
    ).drop("_best", "_errors")


def at_edge(ratio: Column) -> Column:
    """-1 for a ratio that does not apply, as the file formats write it."""
    return F.coalesce(ratio, F.lit(-1.0))


def overall_metrics(sims: DataFrame, *keys: str) -> DataFrame:
    """Macro means of the ratios in per cent (without those that do not apply), micro sums beside them."""
    means = [(F.avg(m) * 100).alias(m) for m in METRICS]
    sums = [F.sum(c).alias(f"total_{c}") for c in ("n_expected", "n_matched", "n_errors", "n_recovered")]
    return sims.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), *means, *sums)


def run_results(sims: DataFrame, keys: tuple[str, ...] = ("domain", "run_id")) -> DataFrame:
    """(keys, num_tasks, num_success, avg_reward, success_rate in per cent) of each run."""
    return sims.groupBy(*keys).agg(
        F.count("*").alias("num_tasks"),
        F.count_if(F.col("reward") > 0).alias("num_success"),
        F.avg("reward").alias("avg_reward"),
        (F.count_if(F.col("reward") > 0) * 100 / F.count("*")).alias("success_rate"),
    )


def exact_round(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, the same in any engine."""
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def domain_rollup(runs: DataFrame, *more_keys: str) -> DataFrame:
    """Runs to domains, weighted by their tasks; failed runs (no tasks) do not count.  Reward to 4 digits, rate to 2."""
    good = runs.where(F.col("num_tasks") > 0)
    n = F.sum("num_tasks")
    return good.groupBy("domain", *more_keys).agg(
        F.count("*").alias("num_runs"),
        n.alias("total_tasks"),
        F.sum("num_success").alias("total_success"),
        exact_round(F.sum(F.col("avg_reward") * F.col("num_tasks")) / n, 4).alias("avg_reward"),
        exact_round(F.sum("num_success") * 100 / n, 2).alias("avg_success_rate"),
    )


def overall_macro(domains: DataFrame) -> DataFrame:
    """Unweighted mean of the domains' rounded values, and the sums."""
    return domains.agg(
        F.count("*").alias("num_domains"),
        F.sum("total_tasks").alias("total_tasks"),
        F.sum("total_success").alias("total_success"),
        exact_round(F.avg(F.col("avg_reward").cast("decimal(20,6)")), 4).alias("avg_reward"),
        exact_round(F.avg(F.col("avg_success_rate").cast("decimal(20,6)")), 2).alias("avg_success_rate"),
    )


def scores_by_run(runs: DataFrame, domains: list[str], num_runs: int) -> DataFrame:
    """A score for each of the given domains and runs; a run that failed or is missing scores 0."""
    spark = runs.sparkSession
    spine = spark.createDataFrame([(d,) for d in domains], "domain string").select("domain", F.explode(F.sequence(F.lit(0), F.lit(num_runs - 1))).alias("run_id"))
    return spine.join(runs.select("domain", F.col("run_id").cast("int").alias("run_id"), "success_rate"), ["domain", "run_id"], "left").select("domain", "run_id", exact_round(F.coalesce("success_rate", F.lit(0.0)), 2).alias("score"))


def scores_pivot(scores: DataFrame, domains: list[str]) -> DataFrame:
    """A row for each run with a column for each domain and their mean."""
    wide = scores.groupBy("run_id").pivot("domain", domains).agg(F.max("score"))
    total = sum((F.col(d).cast("decimal(20,6)") for d in domains[1:]), F.col(domains[0]).cast("decimal(20,6)"))
    return wide.withColumn("avg_per_run", exact_round(total / len(domains), 2))


def failure_counts(checks: DataFrame, key: str = "domain") -> DataFrame:
    """Per key and action: calls that are missing (score 0, not found) and with wrong parameters (score 0, found)."""
    zero = F.col("score") == 0
    found = F.coalesce(F.col("found"), F.lit(False))
    return checks.groupBy(key, "action").agg(F.count_if(zero & ~found).alias("missing"), F.count_if(zero & found).alias("wrong_params"))


def top_per_key(rows: DataFrame, key: str, value: str, name: str, k: int) -> DataFrame:
    """The ``k`` largest of each key, ties by name."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), name))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
