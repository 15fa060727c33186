"""Reports over runs, records and tasks: grouped sums and their ratios, with 0 where there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.scoring import ratio
from trajlake.functions.text import is_connection_error
from trajlake.operators.numbering import numbered
from trajlake.operators.sequence import error_runs

# Counters of a synthetic record, and the reason that means a run was cut off.
HALLUCINATION = ("total_hallucination_count", "hallucinated_tool_count", "hallucinated_param_count", "resolved_count", "failed_count")
PRUNING = ("total_segments_detected", "segments_pruned", "segments_kept")
CUT_OFF = "max_steps"
# End of fixed values.


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def domain_statistics(sims: DataFrame, key: str = "domain") -> DataFrame:
    """Per domain: simulations that succeeded and failed, steps (messages) in sum and mean, and how many were cut off.

    ``sims``: key, reward, n_steps, termination_reason."""
    good = F.coalesce(F.col("reward") > 0, F.lit(False))
    return sims.groupBy(key).agg(
        F.count("*").alias("total_tasks"),
        F.count_if(good).alias("successful_tasks"),
        F.count_if(~good).alias("failed_tasks"),
        F.sum("n_steps").alias("total_steps"),
        F.avg("n_steps").alias("avg_steps"),
        F.count_if(F.col("termination_reason") == CUT_OFF).alias("max_steps_tasks"),
        (F.count_if(good) * 100 / F.count("*")).alias("success_rate"),
    )


def terminations(sims: DataFrame, key: str = "domain") -> DataFrame:
    return sims.groupBy(key, F.coalesce("termination_reason", F.lit("unknown")).alias("termination_reason")).agg(F.count("*").alias("n"))


def failing_actions(checks: DataFrame, key: str = "domain") -> DataFrame:
    """Per domain and action, checks of score 0: missing ones (said not to be found) and ones with wrong parameters (all
    others: a check that does not say counts as found).  Actions without either are left out."""
    zero = F.coalesce(F.col("score"), F.lit(0.0)) == 0
    found = F.coalesce(F.col("found"), F.lit(True))
    counted = checks.groupBy(key, F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count_if(zero & ~found).alias("missing"), F.count_if(zero & found).alias("wrong_parameters"))
    return counted.where("missing + wrong_parameters > 0")


def by_success_rate(statistics: DataFrame, key: str = "domain") -> DataFrame:
    """Domains from the worst to the best."""
    return statistics.orderBy("success_rate", key)


def attempt_statistics(results: DataFrame, *keys: str) -> DataFrame:
    """Tasks that succeeded and failed, their rate, and attempts in sum and mean; ``results``: keys, success, num_attempts.

    Without keys one row over all domains."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("total_tasks"),
        F.count_if("success").alias("successful_tasks"),
        F.count_if(~F.col("success")).alias("failed_tasks"),
        ratio(F.count_if("success"), F.count("*"), 0.0).alias("success_rate"),
        F.coalesce(F.sum("num_attempts"), F.lit(0)).alias("total_attempts"),
        ratio(F.sum("num_attempts"), F.count("*"), 0.0).alias("avg_attempts_per_task"),
    )


def failure_history(attempts: DataFrame, key: str = "task_id") -> DataFrame:
    """Per task: attempts, failures, their rate, and the tools that failed, in order with repeats.

    ``attempts``: key, success, seq, fail_tools array (may be null)."""
    tools = F.when(~F.col("success"), F.struct("seq", F.coalesce("fail_tools", F.array().cast("array<string>")).alias("t")))
    failures = F.count_if(~F.col("success"))
    return attempts.groupBy(key).agg(
        F.count("*").alias("attempts"), failures.alias("failures"), (failures / F.count("*")).alias("fail_rate"), F.flatten(F.transform(F.array_sort(F.collect_list(tools)), lambda x: x["t"])).alias("fail_tools")
    )


def tool_failures(attempts: DataFrame) -> DataFrame:
    """How often each tool was part of a failed attempt."""
    return attempts.where("NOT success").select(F.explode("fail_tools").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row of successes, failures and exceptions among them; ``results``: success (null: no answer), exception."""
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("exception").isNull()
    return results.agg(F.count_if(good).alias("success_count"), F.count_if(~good).alias("fail_count"), F.count_if(F.col("exception").isNotNull()).alias("exception_count"))


def synthetic_totals(records: DataFrame, total_tasks: int | None = None) -> DataFrame:
    """One row of sums and rates over synthetic records with their counters (``HALLUCINATION``, total_corrections,
    iterations_used array, ``PRUNING``); a missing counter is 0.  ``total_tasks``: tasks tried (those recorded if None)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*HALLUCINATION, "total_corrections", *PRUNING)]
    used = F.coalesce("iterations_used", F.array().cast("array<int>"))
    iterations = F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x)
    summed = records.agg(F.count("*").alias("successful_tasks"), *sums, F.coalesce(F.sum(F.size(used)), F.lit(0)).alias("n_iterations"), F.coalesce(F.sum(iterations), F.lit(0)).alias("sum_iterations"))
    col = F.col
    tried = F.lit(total_tasks).cast("long") if total_tasks is not None else col("successful_tasks")
    return summed.withColumns(
        {
            "total_tasks": tried,
            "success_rate": percent(col("successful_tasks"), tried),
            "avg_hallucinations_per_task": ratio(col(HALLUCINATION[0]), col("successful_tasks"), 0.0),
            "hallucination_success_rate": percent(col("resolved_count"), col(HALLUCINATION[0])),
            "avg_user_corrections_per_task": ratio(col("total_corrections"), col("successful_tasks"), 0.0),
            "avg_correction_iterations": ratio(col("sum_iterations"), col("n_iterations"), 0.0),
            "pruning_rate": percent(col("segments_pruned"), col("total_segments_detected")),
        }
    ).drop("n_iterations", "sum_iterations")


def record_summary(records: DataFrame) -> DataFrame:
    """The rates of each synthetic record from its own counters; other columns stay."""
    used = F.coalesce("iterations_used", F.array().cast("array<int>"))
    total = F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x)
    return records.withColumns(
        {
            "hallucination_success_rate": percent(F.col("resolved_count"), F.col(HALLUCINATION[0])),
            "avg_correction_iterations": ratio(total, F.size(used), 0.0),
            "pruning_rate": percent(F.col("segments_pruned"), F.col("total_segments_detected")),
        }
    )


def batch_report(checked: DataFrame) -> DataFrame:
    """One row over checked tasks (valid, score): totals, mean score and pass rate."""
    return checked.agg(
        F.count("*").alias("total_tasks"),
        F.count_if("valid").alias("valid_tasks"),
        F.count_if(~F.col("valid")).alias("invalid_tasks"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
        ratio(F.count_if("valid"), F.count("*"), 0.0).alias("pass_rate"),
    )


def notes_values(notes: Column) -> Column:
    """(complexity, task_type) that a generated task's notes name, as ``Complexity: x | Type: y``; null where absent."""
    found = lambda name: F.when(F.contains(notes, F.lit(f"{name}:")), F.trim(F.regexp_extract(notes, rf"(?s){name}:(.*?)(?:\||$|{name}:)", 1)))
    return F.struct(found("Complexity").alias("complexity"), found("Type").alias("task_type"))


def notes_statistics(tasks: DataFrame) -> DataFrame:
    """(measure, value, n): complexities, types and numbers of actions of generated tasks (notes, n_actions)."""
    v = notes_values(F.col("notes"))
    pair = lambda name, c: F.struct(F.lit(name).alias("measure"), c.cast("string").alias("value"))
    spread = tasks.select(F.explode(F.array(pair("complexity", v["complexity"]), pair("task_type", v["task_type"]), pair("n_actions", F.col("n_actions")))).alias("p")).select("p.*")
    return spread.where("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))


def cost_report(usage: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """(component, input_tokens, output_tokens, calls, cost, percentage) from (component, input_tokens, output_tokens);
    prices are for a million tokens.  Components are few: their total is a window over them."""
    sums = usage.groupBy("component").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))
    cost = F.col("input_tokens") / 1_000_000 * input_price + F.col("output_tokens") / 1_000_000 * output_price
    priced = sums.withColumn("cost", cost)
    return priced.withColumn("percentage", percent(F.col("cost"), F.sum("cost").over(Window.partitionBy(F.lit(1)))))


def share_satisfied(flags: Column) -> Column:
    """The share of conditions that hold (an array of booleans, null: not); 1 where there are none."""
    met = F.size(F.filter(flags, lambda x: F.coalesce(x, F.lit(False))))
    return F.when(F.coalesce(F.size(flags), F.lit(0)) == 0, 1.0).otherwise(met / F.size(flags))


def gate(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    """The rows whose score reaches the threshold."""
    return rows.where(F.col(score) >= threshold)


def connection_failures(results: DataFrame, key: str, order: str, message: str, most: int = 50) -> DataFrame:
    """(key, run_start, run_length, trips): runs of consecutive connection errors, and whether one opens the breaker."""
    flagged = results.withColumn("_bad", is_connection_error(F.col(message)))
    return error_runs(flagged, key, order, "_bad").withColumn("trips", F.col("run_length") >= most)


def completeness(expected: Column, called: Column) -> Column:
    """The share of expected names that were called, repeats among the expected ones counted; 1 where none is expected."""
    hit = F.size(F.filter(expected, lambda e: F.array_contains(called, e)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))


def tools_of_kinds(tasks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(task_id, one number for each kind): how many of a task's expected tools are of a kind in its domain, repeats
    counted.  ``tasks``: task_id, domain, tools array; ``kinds``: domain, tool, kind (a small table)."""
    names = [r["kind"] for r in kinds.select("kind").distinct().orderBy("kind").collect()]
    spread = tasks.select("task_id", "domain", F.explode_outer("tools").alias("tool")).join(kinds, ["domain", "tool"], "left")
    return spread.groupBy("task_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in names])


def top_examples(db: DataFrame, n: int, *keys: str) -> DataFrame:
    """(keys, examples): the ``n`` most frequent errors of each group as texts, ties by text.

    Spark keeps the first ``n`` of a group in every task before it shuffles, so a large group is no task's."""
    keys = keys or ("domain", "tool")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "error"))
    first = db.withColumn("_place", place).where(F.col("_place") <= n)
    told = F.concat(F.col("error"), F.lit(" (occurred "), F.col("count").cast("string"), F.lit(" times)"))
    listed = F.array_sort(F.collect_list(F.struct("_place", told.alias("told"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda e: e["told"]).alias("examples"))


def response_chunks(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """(keys, chunk, responses): each group's rows in order, as lists of ``size`` columns' structs, the last one shorter.

    Groups may be of any size: rows get their place in the order of all rows, a group's first place comes from a grouped
    minimum, and only a chunk's rows meet."""
    placed = numbered(rows.select(*keys, *order), [*keys, *order], "_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = placed.alias("r").join(starts.alias("s"), same).select(*[F.col(f"r.{c}").alias(c) for c in (*keys, *order)], (F.floor((F.col("_place") - F.col("_start")) / size)).cast("long").alias("chunk"))
    return joined.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("responses"))


def correction_iterations(records: DataFrame, key: str) -> DataFrame:
    """(key, place, iterations): every record's corrections in order, as a long table of any length."""
    return records.select(key, F.posexplode("iterations_used").alias("place", "iterations"))
