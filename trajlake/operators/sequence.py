"""Operators over the order of messages and calls.

On the array form of a trajectory they are higher-order functions (narrow, one pass); on exploded rows they are
windows over (trajectory, idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_trajectory(key: str = "traj_id", order: str = "idx"):
    return Window.partitionBy(key).orderBy(order)


def trial_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Occurrence number of the key so far, from 0."""
    return rows.withColumn("trial", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def error_runs(results: DataFrame, key: str = "traj_id", order: str = "idx", flag: str = "is_error") -> DataFrame:
    """Runs of consecutive errors: (key, run_start, run_length).  ``results`` holds only tool results, so nothing else
    ends a run."""
    w = per_trajectory(key, order)
    island = F.sum((~F.col(flag)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("_island", island).where(flag).groupBy(key, "_island").agg(F.min(order).alias("run_start"), F.count("*").alias("run_length")).drop("_island")


def longest_error_run(flags: Column) -> Column:
    """Longest run of true in an array, as a fold."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, bad: Column) -> Column:
        run = F.when(bad, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(flags, start, step, lambda acc: acc["most"])


def recovery_check(messages: DataFrame, most_errors: int = 8, most_in_a_row: int = 3) -> DataFrame:
    """(traj_id, n_errors, longest_run, n_unanswered, valid) from rows (traj_id, idx, role, is_error): few errors, few in
    a row, and an assistant's turn after each."""
    w = per_trajectory()
    followed = messages.withColumn("next_role", F.lead("role").over(w))
    sums = followed.groupBy("traj_id").agg(F.count_if("is_error").alias("n_errors"), F.count_if(F.col("is_error") & (F.coalesce("next_role", F.lit("assistant")) != "assistant")).alias("n_unanswered"))
    runs = error_runs(messages.where("role = 'tool'")).groupBy("traj_id").agg(F.max("run_length").alias("longest_run"))
    joined = sums.join(runs, "traj_id", "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
    return joined.withColumn("valid", (F.col("n_errors") <= most_errors) & (F.col("longest_run") <= most_in_a_row) & (F.col("n_unanswered") == 0))


def subsequence_matched(expected: Column, actual: Column) -> Column:
    """How many of ``expected`` occur in ``actual`` in order, taken greedily."""
    return F.aggregate(actual, F.lit(0), lambda i, a: F.when((i < F.size(expected)) & (F.get(expected, i) == a), i + 1).otherwise(i))


def subsequence_reward(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(subsequence_matched(expected, actual) / F.size(expected))


def by_sequence_order(actions: Column) -> Column:
    """Actions by sequence_order (missing: 999), then by their place."""
    keyed = F.transform(actions, lambda a, i: F.struct(F.coalesce(a["sequence_order"], F.lit(999)).alias("o"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["o"] != y["o"], x["o"] - y["o"]).otherwise(x["i"] - y["i"])), lambda k: k["a"])


def truncate_at_last_call(messages: Column) -> Column:
    """Messages up to the last assistant message with a call; null if there is none."""
    places = F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & m["has_call"], i))
    last = F.array_max(places)
    return F.when(last.isNotNull(), F.slice(messages, F.lit(1), last + 1))


def first_after(messages: DataFrame, marks: DataFrame, predicate: Column) -> DataFrame:
    """The first message after each mark (traj_id, mark_idx) that fulfils the predicate: (traj_id, mark_idx, first_idx).

    One pass: the nearest later match is the smallest index from here on, so no pairs are made."""
    later = Window.partitionBy("traj_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    nearest = messages.withColumn("first_idx", F.min(F.when(predicate, F.col("idx"))).over(later)).select("traj_id", F.col("idx").alias("mark_idx"), "first_idx")
    return marks.join(nearest, ["traj_id", "mark_idx"], "left")


def update_without_get(calls: DataFrame, update: Column, get: Column) -> DataFrame:
    """Calls that update although no call before them in the trajectory got anything."""
    before = per_trajectory().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(get.cast("int")).over(before), F.lit(0)) == 1
    return calls.withColumn("_seen", seen).where(update & ~F.col("_seen")).drop("_seen")


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Place of each row when the groups take turns, groups in alphabetical order."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn)


def running_fail_rate(attempts: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("running_fail_rate", F.sum(F.col("failed").cast("int")).over(w) / F.count("*").over(w))


def merge_tool_results(messages: DataFrame) -> DataFrame:
    """Runtime messages to training form: consecutive tool results become one message (texts joined without a sign); calls
    of the user side go, and so do tool results until the user speaks plainly; leading assistant and trailing user go.

    Rows: traj_id, idx, role, content, user_side (a tool result or call of the user side)."""
    w = per_trajectory()
    clean_user = (F.col("role") == "user") & ~F.col("user_side")
    state = F.last(F.when(F.col("user_side"), F.lit(1)).when(clean_user, F.lit(0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.col("user_side") | ((F.col("role") == "tool") & (F.col("_skip") == 1))
    kept = messages.withColumn("_skip", F.coalesce(state, F.lit(0))).where(~gone).drop("_skip")
    before = F.lag("role").over(w)
    starts = F.when((F.col("role") == "tool") & (F.coalesce(before, F.lit("")) == "tool"), 0).otherwise(1)
    grouped = kept.withColumn("_group", starts)
    grouped = grouped.withColumn("_group", F.sum("_group").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("traj_id", "_group").agg(F.min("idx").alias("idx"), F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("content", F.lit("")).alias("content")))), lambda m: m["content"]), "").alias("content")).drop("_group")
    return trim_ends(merged)


def trim_ends(messages: DataFrame) -> DataFrame:
    """Without assistant messages before any other and user messages after all others (system messages stay)."""
    whole = Window.partitionBy("traj_id")
    spoken = F.col("role") != "system"
    first = F.min(F.when(spoken & (F.col("role") != "assistant"), F.col("idx"))).over(whole)
    last = F.max(F.when(spoken & (F.col("role") != "user"), F.col("idx"))).over(whole)
    marked = messages.withColumns({"_first": first, "_last": last})
    head = (F.col("role") == "assistant") & (F.col("idx") < F.coalesce("_first", F.lit(2**31 - 1)))
    tail = (F.col("role") == "user") & (F.col("idx") > F.coalesce("_last", F.lit(-1)))
    return marked.where(~head & ~tail).drop("_first", "_last")
