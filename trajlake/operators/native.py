"""Native result files: messages with structured calls, turned into the columns that metrics and formats need.

Calls and results are read from a trajectory's own array, so nothing is shuffled; only the names of tool results need
the calls before them, which a map of the trajectory's call ids gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.matching import arguments_match, json_parameter_score
from trajlake.functions.text import has_error_word, text_or_empty, tool_result_preview
from trajlake.operators.metrics import agent_actions, simulation_metrics


def structured_calls(messages: Column) -> Column:
    """Calls of the assistant's messages in order: (turn, number, id, name, arguments as JSON text)."""
    own = lambda m, i: F.transform(
        F.when(m["role"] == "assistant", F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")),
        lambda c: F.struct(i.cast("int").alias("turn"), c["id"].alias("id"), c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")),
    )
    flat = F.flatten(F.transform(messages, own))
    return F.transform(flat, lambda c, k: F.struct(c["turn"].alias("turn"), k.cast("int").alias("number"), c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments")))


def tool_results(messages: Column, size: int = 200) -> Column:
    """Tool messages in order: (turn, number, id, content cut to ``size`` characters, is_error of the whole text)."""
    placed = F.transform(messages, lambda m, i: F.struct(i.cast("int").alias("turn"), m["role"].alias("role"), m["tool_call_id"].alias("id"), m["content"].alias("content")))
    kept = F.filter(placed, lambda m: m["role"] == "tool")
    return F.transform(
        kept, lambda m, k: F.struct(m["turn"].alias("turn"), k.cast("int").alias("number"), m["id"].alias("id"), tool_result_preview(m["content"], size).alias("content"), has_error_word(m["content"]).alias("is_error"))
    )


def named_results(messages: Column, size: int = 200) -> Column:
    """``tool_results`` with the name of the latest earlier call of the same id; ``unknown`` without one."""
    calls = structured_calls(messages)

    def named(r: Column) -> Column:
        before = F.filter(calls, lambda c: (c["id"] == r["id"]) & (c["turn"] < r["turn"]))
        return F.struct(r["turn"].alias("turn"), r["number"].alias("number"), F.coalesce(F.try_element_at(before, F.lit(-1))["name"], F.lit("unknown")).alias("tool"), r["content"].alias("content"), r["is_error"].alias("is_error"))

    return F.transform(tool_results(messages, size), named)


def agent_responses(messages: Column) -> Column:
    """The assistant's messages with their place and what the model thought: (turn, content, tool_calls, reasoning, thinking)."""
    placed = F.transform(
        messages,
        lambda m, i: F.struct(
            i.cast("int").alias("turn"), m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls"), m["raw_data"]["reasoning_content"].alias("reasoning_content"), m["raw_data"]["thinking"].alias("thinking")
        ),
    )
    return F.transform(F.filter(placed, lambda m: m["role"] == "assistant"), lambda m: m.dropFields("role"))


def native_simulations(sims: DataFrame, tasks: DataFrame, *keys: str) -> DataFrame:
    """What ``metrics.simulation_metrics`` needs, from ``readers.simulations`` and ``readers.result_tasks`` of native files.

    A task is found by id or position; a simulation without one expects nothing.  Expected actions are the agent's own.
    The simulations' columns stay; a reward of null or zero gives way to the inner one where the table has it."""
    actions = F.col("task.evaluation_criteria.actions")
    expected = tasks.select(*keys, F.col("key").alias("task_id"), agent_actions(actions).alias("_expected"), F.col("task.expected_turns").alias("expected_turns"))
    joined = sims.join(expected, [*keys, "task_id"], "left")
    part = lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments"))
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    spoken = F.filter("messages", lambda m: m["role"].isin("assistant", "user"))
    return joined.withColumns(
        {
            "expected": F.coalesce(F.transform("_expected", part), none),
            "calls": F.transform(structured_calls(F.col("messages")), part),
            "results": F.transform(F.filter("messages", lambda m: m["role"] == "tool"), lambda m: text_or_empty(m["content"])),
            "n_messages": F.size(spoken),
        }
    ).drop("_expected")


def native_metrics(sims: DataFrame) -> DataFrame:
    """``simulation_metrics`` of ``native_simulations``: arguments are JSON text, values of any depth."""
    return simulation_metrics(sims, json_parameter_score)


def matching_calls(expected: Column, calls: Column) -> Column:
    """Of each expected action (name, arguments, compare_args) whether some call has its name and agrees in the arguments
    that are to be compared."""
    return F.transform(expected, lambda e: F.exists(calls, lambda c: (c["name"] == e["name"]) & arguments_match(e["arguments"], c["arguments"], e["compare_args"])))

