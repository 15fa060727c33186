"""Judging and rewriting by a provider until nothing changes, on the rows that still change.

The loop runs on the driver, each turn one job over its frontier: the rows whose last turn changed them or left them at
fault.  What a turn has settled is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.text import all_tool_calls, reply_too_long, text_or_empty
from trajlake.operators.provider import Provider, checked, generate
from trajlake.storage import cut


def reply_faults(reply: Column) -> Column:
    """What is wrong with a user's reply, as texts."""
    return F.filter(F.array(F.when(reply_too_long(reply), "too long"), F.when(F.trim(text_or_empty(reply)) == "", "empty")), lambda x: x.isNotNull())


def reflected(rows: DataFrame, reply: str, provider: Provider, faults: Callable[[Column], Column] = reply_faults, most: int = 3, retries: int = 3) -> DataFrame:
    """``rows`` with ``reply`` as improved, ``iterations`` (the last turn that changed it, 0: none) and ``valid``.

    A turn tells the provider the reply and its faults; the answer may hold an ``improved_response``.  A row is settled when
    a turn leaves it as it is and it has no fault; the others are asked again, ``most`` times at the most."""
    left = rows.withColumns({"iterations": F.lit(0)})
    done = None
    for turn in range(1, most + 1):
        wrong = F.coalesce(faults(F.col(reply)), F.array().cast("array<string>"))
        prompt = F.concat_ws("\n", F.lit('Review the reply and its faults. Answer {"improved_response": text or null}.'), F.concat(F.lit("Faults: "), F.array_join(wrong, "; ")), F.concat(F.lit("Reply: "), text_or_empty(F.col(reply))))
        asked = checked(left.withColumn("_prompt", prompt), "_prompt", "improved_response string", lambda a: F.length(F.trim(a["improved_response"])) > 0, provider, 1)
        better = F.col("found.improved_response")
        changed = F.coalesce(better != text_or_empty(F.col(reply)), F.lit(False))
        told = asked.withColumns({"_changed": changed, "_settled": ~changed & (F.size(wrong) == 0)})
        told = cut(told.withColumns({reply: F.when(F.col("_changed"), better).otherwise(F.col(reply)), "iterations": F.when(F.col("_changed"), F.lit(turn)).otherwise(F.col("iterations"))}).drop("_prompt", "found", "_changed"))
        settled = told.where("_settled").drop("_settled")
        done = settled if done is None else done.unionByName(settled)
        left = told.where("not _settled").drop("_settled")
        if left.isEmpty():
            break
    out = left if done is None else done.unionByName(left)
    return out.withColumn("valid", F.size(F.coalesce(faults(F.col(reply)), F.array().cast("array<string>"))) == 0)


def information_told(rows: DataFrame, key: str, transcript: str, items: str, provider: Provider, retries: int = 3) -> DataFrame:
    """(key, told, share) for rows with a transcript and the pieces of information (an array) that it must convey: which of
    them the provider finds there (those that stand there word for word need no asking), and their share; 1 for none."""
    spread = rows.select(key, transcript, F.posexplode(items).alias("_n", "_item"))
    literal = F.contains(F.lower(text_or_empty(F.col(transcript))), F.lower(F.col("_item")))
    known = spread.where(literal).select(key, "_n", F.lit(True).alias("_told"))
    open_items = spread.where(~F.coalesce(literal, F.lit(False)))
    prompt = F.concat_ws("\n", F.lit('Does the agent convey this? Answer {"conveyed": true or false}.'), F.concat(F.lit("Information: "), F.col("_item")), F.concat(F.lit("Conversation: "), F.col(transcript)))
    judged = checked(open_items.withColumn("_prompt", prompt), "_prompt", "conveyed boolean", lambda a: a["conveyed"].isNotNull(), provider, retries)
    answers = known.unionByName(judged.select(key, "_n", F.coalesce("found.conveyed", F.lit(False)).alias("_told")))
    listed = answers.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_told"))), lambda x: x["_told"]).alias("told"))
    out = rows.select(key).join(listed, key, "left").withColumn("told", F.coalesce("told", F.array().cast("array<boolean>")))
    return out.withColumn("share", F.when(F.size("told") == 0, 1.0).otherwise(F.size(F.filter("told", lambda x: x)) / F.size("told")))


def continued(messages: DataFrame, segments: DataFrame, provider: Provider, retries: int = 3) -> DataFrame:
    """``segments`` (traj_id, start_idx, fix_idx, corrected) with ``corrected`` worded so that it follows from the two
    messages before the segment and leads to the two behind its fix; for ``inject.prune_segments``.

    A wording that changes the calls in the text, or none at all, leaves it as it is."""
    w = Window.partitionBy("traj_id").orderBy("idx")
    line = F.concat(F.col("role"), F.lit(": "), text_or_empty(F.col("content")))
    around = messages.select("traj_id", "idx", "content", F.concat_ws("\n", F.lag(line, 2).over(w), F.lag(line, 1).over(w)).alias("before"), F.concat_ws("\n", F.lead(line, 1).over(w), F.lead(line, 2).over(w)).alias("after"))
    start = around.select("traj_id", F.col("idx").alias("start_idx"), "before")
    fix = around.select("traj_id", F.col("idx").alias("fix_idx"), "after", F.col("content").alias("_own"))
    joined = segments.join(start, ["traj_id", "start_idx"]).join(fix, ["traj_id", "fix_idx"]).withColumn("_text", F.coalesce("corrected", "_own"))
    prompt = F.concat_ws("\n", F.lit('Reword the response as if nothing had gone wrong. Answer {"fixed_response": text}.'), F.concat(F.lit("Before: "), F.col("before")), F.concat(F.lit("Response: "), F.col("_text")), F.concat(F.lit("After: "), F.col("after")))
    asked = checked(joined.withColumn("_prompt", prompt), "_prompt", "fixed_response string", lambda a: F.length(F.trim(a["fixed_response"])) > 0, provider, retries)
    calls = lambda c: F.to_json(all_tool_calls(c))
    fixed = F.col("found.fixed_response")
    fine = F.coalesce(calls(fixed) == calls(F.col("_text")), F.lit(False))
    return asked.select(*[c for c in segments.columns if c != "corrected"], F.when(fine, fixed).otherwise(F.col("_text")).alias("corrected"))


# The headings of the three kinds of analysis.
HEADINGS = {"success": "## Success Analysis", "error": "## Error Analysis", "contrast": "## Contrast Analysis"}
# End of fixed values.


def attempt_analyses(attempts: DataFrame, provider: Provider, retries: int = 3) -> DataFrame:
    """(kind, task_id, attempt, messages): training rows from the attempts (task_id, attempt, reward, transcript) at tasks.

    Every successful attempt gives an analysis of its success, every failed one of its error, and a failed one of a task
    that was solved a contrast with the task's first solution.  An answer without its kind's heading gets it."""
    solved = F.coalesce("reward", F.lit(0.0)) > 0
    first = attempts.where(solved).groupBy("task_id").agg(F.min_by("transcript", "attempt").alias("_solution"))
    single = attempts.select(F.when(solved, "success").otherwise("error").alias("kind"), "task_id", "attempt", F.col("transcript").alias("_shown"))
    pair = attempts.where(~solved).join(first, "task_id").select(F.lit("contrast").alias("kind"), "task_id", "attempt", F.concat_ws("\n\n", F.concat(F.lit("Failed:\n"), F.col("transcript")), F.concat(F.lit("Solved:\n"), F.col("_solution"))).alias("_shown"))
    rows = single.unionByName(pair)
    heading = F.create_map(*[F.lit(x) for item in HEADINGS.items() for x in item])[F.col("kind")]
    asked = rows.withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Write a "), F.col("kind"), F.lit(" analysis under the heading "), heading), "_shown"))
    answered = generate(asked, "prompt", "_answer", provider, retries).where(F.length(F.trim("_answer")) > 0)
    told = F.when(F.contains("_answer", heading), F.col("_answer")).otherwise(F.concat_ws("\n", heading, "_answer"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return answered.select("kind", "task_id", "attempt", F.array(message("user", F.col("prompt")), message("assistant", told)).alias("messages"))
