"""Text generation as a pluggable row function, called partition by partition.

Prompts go through a ``Provider``; its answers come back as a column and are then checked by ordinary expressions, with
a rule to fall back on.  ``RuleProvider`` answers from the prompt alone, for tests and as that fallback.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trajlake.functions.matching import bare, json_map
from trajlake.functions.text import outer_object, strip_code_fence
from trajlake.operators.sequence import first_after
from trajlake.operators.validate import dimension_gate, same_format
from trajlake.storage import cut


class Provider(Protocol):
    """Answers prompts; None where it has no answer.  Must be picklable; connections are opened in ``open``."""

    def open(self) -> None: ...

    def answer(self, prompts: list[str]) -> list[str | None]: ...


class RuleProvider:
    """A deterministic answer: JSON with the prompt's length and its first word."""

    def open(self) -> None:
        pass

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [json.dumps({"summary": (p.split() or [""])[0], "length": len(p)}) if p else None for p in prompts]


def generate(rows: DataFrame, prompt: str, answer: str, provider: Provider, retries: int = 3, batch: int = 64) -> DataFrame:
    """``rows`` with the column ``answer``; a prompt is tried up to ``retries`` times, then its answer is null."""
    schema = StructType([*rows.schema.fields, StructField(answer, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for pdf in batches:
            answers: list[str | None] = []
            for k in range(0, len(pdf), batch):
                prompts = [p or "" for p in pdf[prompt].iloc[k : k + batch]]
                got = provider.answer(prompts)
                for _ in range(retries - 1):
                    again = [i for i, a in enumerate(got) if a is None and prompts[i]]
                    if not again:
                        break
                    for i, a in zip(again, provider.answer([prompts[i] for i in again]), strict=True):
                        got[i] = a
                answers += got
            yield pdf.assign(**{answer: answers})

    return rows.mapInPandas(run, schema)


def parsed_answer(answer: Column, schema: str) -> Column:
    """The JSON object in an answer, without fences and talk around it; null if it does not parse."""
    return F.from_json(outer_object(strip_code_fence(answer)), schema)


def with_fallback(answer: Column, valid: Column, rule: Column) -> Column:
    """The answer where it passes its check, else the rule's."""
    return F.when(F.coalesce(valid, F.lit(False)), answer).otherwise(rule)


def analysis_rows(trajectories: DataFrame, provider: Provider) -> DataFrame:
    """A training row for each trajectory: its transcript as the question, the analysis as the answer."""
    asked = trajectories.withColumn("prompt", F.concat(F.lit("Analyse:\n"), F.col("transcript")))
    out = generate(asked, "prompt", "analysis", provider).where("analysis is not null")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return out.select("traj_id", F.array(message("user", "prompt"), message("assistant", "analysis")).alias("messages"))


def checked(rows: DataFrame, prompt: str, schema: str, valid: Callable[[Column], Column], provider: Provider, retries: int = 3) -> DataFrame:
    """``rows`` with ``found``, the parsed answer to each prompt if ``valid`` holds for it, else null.

    A prompt whose answer does not pass is asked again, up to ``retries`` times; rows that have passed are not."""
    done, left = None, rows
    for _ in range(retries):
        asked = generate(left, prompt, "_answer", provider, retries=1)
        found = parsed_answer(F.col("_answer"), schema)
        tried = cut(asked.withColumn("found", F.when(F.coalesce(valid(found), F.lit(False)), found)).drop("_answer"))
        passed = tried.where("found is not null")
        done = passed if done is None else done.unionByName(passed)
        left = tried.where("found is null").drop("found")
    return done.unionByName(left.withColumn("found", F.lit(None).cast(done.schema["found"].dataType)))


def error_answers(points: DataFrame, provider: Provider, rule: DataFrame, retries: int = 3) -> DataFrame:
    """(key, wrong, error, source) for calls (key, tool, arguments, prompt): the provider's wrong arguments and message where
    every argument keeps its form and something differs, else those of ``rule`` (key, wrong, error)."""
    answered = checked(points, "prompt", "wrong_arguments string, error_message string", lambda a: a["error_message"].isNotNull() & json_map(a["wrong_arguments"]).isNotNull(), provider, retries)
    right, wrong = json_map(F.col("arguments")), json_map(F.col("found.wrong_arguments"))
    kept = F.forall(F.map_keys(wrong), lambda k: ~F.map_contains_key(right, k) | same_json_format(F.element_at(right, k), F.element_at(wrong, k)))
    fine = F.coalesce(F.col("found").isNotNull() & kept & (F.map_entries(right) != F.map_entries(wrong)), F.lit(False))
    joined = answered.join(rule.select("key", F.col("wrong").alias("_wrong"), F.col("error").alias("_error")), "key", "left").withColumn("_fine", fine)
    return joined.select("key", with_fallback(F.col("found.wrong_arguments"), F.col("_fine"), F.col("_wrong")).alias("wrong"), with_fallback(F.col("found.error_message"), F.col("_fine"), F.col("_error")).alias("error"), F.when(F.col("_fine"), "provider").otherwise("rule").alias("source"))


def same_json_format(original: Column, changed: Column) -> Column:
    """``validate.same_format`` for JSON texts, which must also be of the same kind."""
    kind = lambda v: F.when(F.startswith(v, F.lit('"')), "text").when(v.rlike("^-?[0-9]+$"), "whole").when(v.rlike("^-?[0-9]"), "number").when(v.isin("true", "false"), "flag").otherwise(F.substring(v, 1, 1))
    return (kind(original) == kind(changed)) & same_format(bare(original), bare(changed))


def judged(rows: DataFrame, prompt: str, dimensions: tuple[str, ...], threshold: int, provider: Provider, retries: int = 3) -> DataFrame:
    """``rows`` with ``scores`` (whole numbers 1 to 5 by dimension) and ``passes``: whether every dimension reaches the threshold.
    A row without a usable answer does not pass."""
    schema = ", ".join(f"{d} double" for d in dimensions)
    complete = lambda a: F.forall(F.array(*[a[d].isNotNull() for d in dimensions]), lambda x: x)
    out = checked(rows, prompt, schema, complete, provider, retries)
    scores = F.array(*[F.col("found")[d] for d in dimensions])
    return out.withColumns({"scores": F.map_from_arrays(F.array(*map(F.lit, dimensions)), F.transform(scores, lambda s: F.when(s.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), s.cast("int")))))), "passes": F.col("found").isNotNull() & F.coalesce(dimension_gate(scores, threshold), F.lit(False))}).drop("found")


def detected_segments(messages: DataFrame, provider: Provider, retries: int = 3) -> DataFrame:
    """(traj_id, start_idx, end_idx, fix_idx): error segments that the provider finds in each trajectory; the fix is the first
    assistant message behind the segment, and a segment without one is left out.

    ``messages``: traj_id, idx, role, content."""
    listed = messages.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    shown = F.array_join(F.transform("m", lambda x: F.concat(x["idx"].cast("string"), F.lit(" "), x["role"], F.lit(": "), F.coalesce(x["content"], F.lit("")))), "\n")
    asked = listed.select("traj_id", F.concat(F.lit("Find the segments in which the user complains of an error. Answer {\"segments\": [{\"start\": n, \"end\": n}]}.\n"), shown).alias("prompt"))
    found = checked(asked, "prompt", "segments array<struct<start:long,end:long>>", lambda a: a["segments"].isNotNull(), provider, retries)
    marks = found.select("traj_id", F.explode("found.segments").alias("s")).select("traj_id", F.col("s.start").alias("start_idx"), F.col("s.end").alias("mark_idx"))
    after = first_after(messages, marks, F.col("role") == "assistant").where("first_idx is not null")
    return after.select("traj_id", "start_idx", F.col("mark_idx").alias("end_idx"), F.col("first_idx").alias("fix_idx"))


def votes_of(segments: DataFrame, prompt: str, agents: int, rounds: int, provider: Provider) -> DataFrame:
    """(segment_id, round, agent_id, should_prune): the votes of several agents in several rounds, each asked by itself."""
    seats = F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")
    asked = segments.select("segment_id", F.col(prompt).alias("_p"), seats).select("*", F.explode(F.sequence(F.lit(1), F.lit(agents))).alias("agent_id"))
    asked = asked.withColumn("prompt", F.concat_ws("\n", "_p", F.concat(F.lit("You are agent "), F.col("agent_id").cast("string"), F.lit(" in round "), F.col("round").cast("string"))))
    out = checked(asked, "prompt", "prune boolean", lambda a: a["prune"].isNotNull(), provider)
    return out.select("segment_id", "round", "agent_id", F.coalesce("found.prune", F.lit(False)).alias("should_prune"))


def design_chain(seeds: DataFrame, provider: Provider, retries: int = 3) -> DataFrame:
    """(seed_id, design, scenario, criteria) for the seeds (seed_id, prompt) that every step of the chain answers: a design
    from the seed, a scenario from the design, criteria from both.  A step that fails ``retries`` times drops its seed."""
    rows, steps = seeds.select("seed_id", "prompt"), (("design", "reason string, tools array<string>", "tools"), ("scenario", "persona string, instructions string", "instructions"), ("criteria", "actions array<string>, assertions array<string>", "actions"))
    for name, schema, needed in steps:
        found = checked(rows, "prompt", schema, lambda a, k=needed: a[k].isNotNull(), provider, retries).where("found is not null")
        rows = found.withColumn(name, F.to_json("found")).withColumn("prompt", F.concat_ws("\n", "prompt", F.concat(F.lit(f"{name}: "), F.col(name)))).drop("found")
    return rows.select("seed_id", "design", "scenario", "criteria")


def attempt_loop(tasks: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], analyse: Callable[[DataFrame], DataFrame], most_attempts: int = 3) -> DataFrame:
    """(task_id, attempt, reward, trajectory) of every attempt: tasks (task_id, prompt) are tried until they succeed or
    ``most_attempts`` are made, and the analysis of a failed attempt goes into the next one's prompt.

    ``attempt`` gives (task_id, prompt, reward, trajectory), ``analyse`` (task_id, analysis) for failed rows.  The driver loops
    over attempts; each is one job over all tasks that are left."""
    results, left = None, tasks.select("task_id", "prompt")
    for k in range(1, most_attempts + 1):
        tried = cut(attempt(left, k).withColumn("attempt", F.lit(k)))
        rows = tried.select("task_id", "attempt", "reward", "trajectory")
        results = rows if results is None else results.unionByName(rows)
        failed = tried.where(F.coalesce("reward", F.lit(0.0)) <= 0)
        if k == most_attempts or failed.isEmpty():
            break
        learned = failed.select("task_id", "prompt").join(analyse(failed), "task_id", "left")
        left = learned.select("task_id", F.concat_ws("\n", "prompt", "analysis").alias("prompt"))
    return results


def inject_errors(points: DataFrame, how: str, db: DataFrame, seed: int, provider: Provider | None = None, prompt: Column | None = None) -> DataFrame:
    """Wrong calls for (key, domain, tool, arguments) by ``rule`` (the error database and corruption) or by ``agent`` (a provider,
    with the rule where it gives nothing usable): (key, wrong, error, recovery, source)."""
    from trajlake.operators.faults import rule_errors

    rule = rule_errors(points, db, seed)
    if how == "rule":
        return rule.select("key", "wrong", "error", "recovery", F.lit("rule").alias("source"))
    if how != "agent" or provider is None or prompt is None:
        raise ValueError("how is 'rule', or 'agent' with a provider and a prompt")
    answered = error_answers(points.withColumn("prompt", prompt), provider, rule)
    return answered.join(rule.select("key", "recovery"), "key").select("key", "wrong", "error", "recovery", "source")
