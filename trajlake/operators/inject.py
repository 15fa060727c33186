"""Putting tool-use errors, with their recoveries, into good trajectories; and taking error segments out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.text import first_tool_call, is_error_response, response_result
from trajlake.operators.sampling import shuffle_key, uniform

# The messages of an injected error and its recovery; {param}, {wrong}, {value}, {error} are filled in.
ERROR_MESSAGES = (
    "Invalid {param}: '{wrong}' is not a valid format",
    "Parameter '{param}' validation failed: expected valid identifier, got '{wrong}'",
    "Error processing {param}: '{wrong}' does not match expected pattern",
)
# End of fixed values.


def injection_points(messages: DataFrame) -> DataFrame:
    """Assistant messages with a parsable call whose next message is a tool result without an error.

    Rows: traj_id, idx, role, content, call_name (null: no call).  Returns those rows."""
    w = Window.partitionBy("traj_id").orderBy("idx")
    seen = messages.withColumns({"_next_role": F.lead("role").over(w), "_next": F.lead("content").over(w)})
    good = (F.col("role") == "assistant") & F.col("call_name").isNotNull() & (F.col("_next_role") == "tool") & ~is_error_response(F.col("_next"))
    return seen.where(good).drop("_next_role", "_next")


def choose_points(points: DataFrame, most: int, rate: float, seed: int) -> DataFrame:
    """Of each trajectory, up to ``most`` points in hash order, each kept with probability ``rate``."""
    key = F.concat_ws(":", "traj_id", "idx")
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy(shuffle_key(key, seed), "idx"))
    return points.withColumns({"_rank": rank, "_u": uniform(key, seed + 1)}).where((F.col("_rank") <= most) & (F.col("_u") < rate)).drop("_rank", "_u")


def corrupt_text(value: Column, mode: Column) -> Column:
    """A wrong value of the same kind: numbers are moved, identifiers keep their form, other text is cut, doubled or reversed."""
    number = value.try_cast("long")
    moved = F.element_at(F.array(*map(F.lit, (10, -10, 50, -50, 100, -100))), (F.pmod(mode, F.lit(6)) + 1).cast("int"))
    digits = F.regexp_replace(value, "[0-9]", "9")
    other = F.when(F.pmod(mode, F.lit(3)) == 0, F.concat(value, F.lit("_x"))).when(F.pmod(mode, F.lit(3)) == 1, F.reverse(value)).otherwise(F.substring(value, 2, 1 << 20))
    formed = F.when(digits != value, digits).otherwise(F.concat(value, F.lit("0")))
    out = F.when(number.isNotNull(), (number + moved).cast("string")).when(value.rlike(r"^(#W\d+|[LPBCD]\d{4,}|[A-Z0-9]{6}|[a-z]+_[a-z]+_\d+)$"), formed).otherwise(other)
    return F.when(out == value, F.concat(value, F.lit("_x"))).otherwise(out)


def corrupt_json_value(value: Column, mode: Column) -> Column:
    """``corrupt_text`` for JSON text: lists lose their last element, objects their first key, numbers are scaled."""
    as_list = F.from_json(value, "array<string>")
    as_map = F.from_json(value, "map<string,string>")
    scaled = F.element_at(F.array(*map(F.lit, (0.5, 0.8, 1.2, 1.5))), (F.pmod(mode, F.lit(4)) + 1).cast("int"))
    return (
        F.when(value.startswith("["), F.to_json(F.slice(as_list, F.lit(1), F.greatest(F.lit(0), F.size(as_list) - 1))))
        .when(value.startswith("{"), F.to_json(F.map_filter(as_map, lambda k, v: k != F.map_keys(as_map)[0])))
        .when(value.rlike(r"^-?\d+\.\d+$"), (value.cast("double") * scaled).cast("string"))
        .otherwise(corrupt_text(value, mode))
    )


def error_message(param: Column, wrong: Column, mode: Column) -> Column:
    text = F.element_at(F.array(*map(F.lit, ERROR_MESSAGES)), (F.pmod(mode, F.lit(len(ERROR_MESSAGES))) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{param}"), param), F.lit("{wrong}"), wrong)


def recovery_thought(error: Column) -> Column:
    """A short thought by the kind of error, first match wins."""
    low = F.lower(error)
    has = lambda *words: _all(low, words)
    return (
        F.when(has("payment", "amount"), "The payment amount was wrong; I will recalculate it and retry.")
        .when(has("missing"), "A required parameter was missing; I will include it and retry.")
        .when(has("number", "match"), "The counts did not match; I will check them and retry.")
        .when(low.rlike("validation|invalid"), "The input was not valid; I will correct its format and retry.")
        .when(low.rlike("balance|insufficient"), "The balance did not suffice; I will check the payment method and retry.")
        .otherwise(F.concat(F.lit("The call failed ("), error, F.lit("); I will correct the parameters and retry.")))
    )


def _all(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out & F.contains(text, F.lit(w))
    return out


def splice(messages: DataFrame, injected: DataFrame) -> DataFrame:
    """Every chosen assistant message becomes three: wrong call, error result, thought with the right call.

    ``messages``: traj_id, idx, role, content; ``injected``: traj_id, idx, wrong, error, recovery (texts).  The result
    is numbered anew; a trajectory gains two messages for each error.  One join and one window, whatever the number."""
    joined = messages.join(injected.select("traj_id", "idx", "wrong", "error", "recovery"), ["traj_id", "idx"], "left")
    part = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    three = F.array(part(F.lit("assistant"), F.col("wrong")), part(F.lit("tool"), F.col("error")), part(F.lit("assistant"), F.col("recovery")))
    spread = joined.select("traj_id", "idx", F.posexplode(F.when(F.col("wrong").isNotNull(), three).otherwise(F.array(part(F.col("role"), F.col("content"))))).alias("part", "m"))
    number = F.row_number().over(Window.partitionBy("traj_id").orderBy("idx", "part")) - 1
    return spread.select("traj_id", number.alias("idx"), "m.role", "m.content")


def splice_checked(messages: DataFrame, injected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of ``splice`` for the trajectories that are still well formed, rejected (traj_id, reason)).

    The spliced trajectories pass the same validator as any others, so an injection that breaks the order of roles or
    writes a malformed call takes its trajectory out."""
    from trajlake.operators.validate import message_reason, trajectory_reasons

    spliced = splice(messages, injected)
    call = first_tool_call(F.col("content"))
    reason = message_reason(F.col("role"), F.col("content"), call["name"], call["arguments"], response_result(F.col("content")))
    verdicts = trajectory_reasons(spliced.select("traj_id", "idx", "role", reason.alias("reason")))
    rejected = verdicts.where("not valid").select("traj_id", "reason")
    return spliced.join(rejected.select("traj_id"), "traj_id", "left_anti"), rejected


def online_injection(flags: Column, most: int, most_in_a_row: int) -> Column:
    """Which of the proposed errors (booleans in call order) are made: at most ``most`` in all and ``most_in_a_row`` in
    succession, after which one call is left alone."""
    start = F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("run"))

    def step(acc: Column, wish: Column) -> Column:
        go = wish & (acc["n"] < most) & (acc["run"] < most_in_a_row)
        return F.struct(F.concat(acc["out"], F.array(go)).alias("out"), (acc["n"] + go.cast("int")).alias("n"), F.when(go, acc["run"] + 1).otherwise(0).alias("run"))

    return F.aggregate(flags, start, step, lambda acc: acc["out"])


def prune_segments(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Without the messages of each segment [start_idx, fix_idx); the message at fix_idx stays, with the corrected text.

    ``segments``: traj_id, start_idx, fix_idx, corrected (null: text as it is), for decided segments only.  A window
    carries the latest segment to the messages after its start, so messages and segments are not paired."""
    starts = segments.select("traj_id", F.col("start_idx").alias("idx"), F.lit(0).alias("_kind"), "fix_idx", "corrected")
    rows = messages.select("traj_id", "idx", F.lit(1).alias("_kind"), "role", "content")
    both = rows.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("traj_id").orderBy("idx", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    state = both.withColumn("_seg", F.max(F.when(F.col("_kind") == 0, F.struct("fix_idx", "corrected"))).over(w)).where("_kind = 1")
    inside = F.col("_seg").isNotNull() & (F.col("idx") < F.col("_seg.fix_idx"))
    fixed = F.when(F.col("idx") == F.col("_seg.fix_idx"), F.coalesce("_seg.corrected", "content")).otherwise(F.col("content"))
    return state.where(~inside).select("traj_id", "idx", "role", fixed.alias("content"))


def vote_decisions(votes: DataFrame) -> DataFrame:
    """(segment_id, prune, decided_round): the first unanimous round decides, else the majority of the last (a tie keeps).

    Rows: segment_id, round, agent_id, should_prune."""
    rounds = votes.groupBy("segment_id", "round").agg(F.count("*").alias("n"), F.count_if("should_prune").alias("yes"))
    unanimous = F.min(F.when((F.col("yes") == 0) | (F.col("yes") == F.col("n")), F.struct("round", (F.col("yes") > 0).alias("prune"))))
    last = F.max(F.struct("round", (2 * F.col("yes") > F.col("n")).alias("prune")))
    decided = rounds.groupBy("segment_id").agg(unanimous.alias("u"), last.alias("l"))
    return decided.select("segment_id", F.coalesce("u.prune", "l.prune").alias("prune"), F.coalesce("u.round", "l.round").alias("decided_round"))
