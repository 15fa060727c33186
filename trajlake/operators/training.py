"""Training data: runtime messages and records in the forms that training and prompting take.

Forms that need the order of messages are windows over (trajectory, idx), so a long trajectory costs no more than its
length; the others are projections of a row's own arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.matching import json_map
from trajlake.functions.text import clean_system_prompt, one_json_value, remove_think_tags, strip_text, text_or_empty, without_analysis
from trajlake.functions.scoring import complexity, task_type
from trajlake.operators.sequence import truncate_at_last_call
from trajlake.operators.validate import extractor_format_ok, recovery_ok

# Keys, tags and headings of the formats.
CALL_OPEN, CALL_CLOSE = "<tool_call>", "</tool_call>"
RESPONSE_OPEN, RESPONSE_CLOSE = "<tool_response>", "</tool_response>"
NO_ORDER = 999
# End of fixed values.


def json_text(value: Column) -> Column:
    """A value as JSON: as it is if it is one JSON value already, else as a quoted string."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(one_json_value(value), value).otherwise(F.substr(quoted, F.lit(6), F.length(quoted) - 6))


def _pair(first: str, a: Column, second: str, b: Column) -> Column:
    return F.concat(F.lit(f'{{"{first}": '), a, F.lit(f', "{second}": '), b, F.lit("}"))


def _string(value: Column) -> Column:
    quoted = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substr(quoted, F.lit(6), F.length(quoted) - 6)


def call_text(name: Column, arguments: Column) -> Column:
    return _pair("name", _string(name), "arguments", F.coalesce(arguments, F.lit("{}")))


def response_text(name: Column, result: Column) -> Column:
    return _pair("name", _string(name), "result", json_text(text_or_empty(result)))


# --- runtime messages to training rows ------------------------------------------------------------------------------


def training_rows(messages: DataFrame, strip_think: bool = True) -> DataFrame:
    """(traj_id, idx, role, content) of runtime messages (traj_id, idx, role, content, tool_call_id, tool_calls).

    An assistant's calls become its text, line by line; without calls its text loses its think blocks (``strip_think``).
    Results between two spoken messages become one tool message, each with the name of the latest earlier call of its
    id.  A user message with calls goes, and so do the results after it until the user speaks without any.  Results
    that nothing follows go.  Then a leading assistant and a trailing user message go.  Other roles are left out."""
    has_calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    w = Window.partitionBy("traj_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.where(F.col("role").isin("user", "assistant", "tool")).withColumn("_calls", has_calls)
    skip = F.last(F.when((F.col("role") == "user"), F.col("_calls")), ignorenulls=True).over(so_far)
    named = _with_names(rows)
    kept = named.withColumn("_skip", F.coalesce(skip, F.lit(False))).where(~((F.col("role") == "user") & F.col("_calls")) & ~((F.col("role") == "tool") & F.col("_skip")))
    # results belong to the spoken message that comes next; the number of spoken messages after a row finds it
    after = w.rowsBetween(1, Window.unboundedFollowing)
    placed = kept.withColumns({"_spoken": (F.col("role") != "tool").cast("int"), "_later": F.coalesce(F.sum((F.col("role") != "tool").cast("int")).over(after), F.lit(0))})
    placed = placed.where((F.col("role") != "tool") | (F.col("_later") > 0))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(F.lit(f"\n{CALL_OPEN}\n"), call_text(c["name"], c["arguments"]), F.lit(f"\n{CALL_CLOSE}"))), "")
    spoken = remove_think_tags(text_or_empty(F.col("content"))) if strip_think else text_or_empty(F.col("content"))
    content = F.when(F.col("role") == "tool", response_text(F.col("_name"), F.col("content"))).when(F.col("role") == "user", F.col("content")).when(F.col("_calls"), calls).otherwise(spoken)
    texts = placed.select("traj_id", "idx", "role", "_later", content.alias("content"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text_or_empty(F.col("content")).alias("content")))), lambda m: m["content"]), "")
    merged = texts.groupBy("traj_id", "_later", "role").agg(F.min("idx").alias("idx"), F.when(F.count("content") > 0, joined).alias("content"))
    back = Window.partitionBy("traj_id").orderBy("idx")
    ends = merged.withColumns({"_before": F.lag("role").over(back), "_after": F.lead("role").over(back)})
    first = F.col("_before").isNull() & (F.col("role") == "assistant")
    # a lone user message goes too; so does one that only a leading assistant stands before
    last = F.col("_after").isNull() & (F.col("role") == "user")
    return ends.where(~first & ~last).select("traj_id", "idx", "role", "content")


def _with_names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_name``: for a result the name of the latest earlier call of its id, else ``unknown``.  Calls and
    results meet in windows of (trajectory, call id)."""
    calls = rows.where(F.col("role") == "assistant").select("traj_id", "idx", F.explode("tool_calls").alias("_c")).select("traj_id", "idx", F.col("_c.id").alias("tool_call_id"), F.col("_c.name").alias("_name"))
    results = rows.where(F.col("role") == "tool").select("traj_id", "idx", "tool_call_id", F.lit(None).cast("string").alias("_name"))
    w = Window.partitionBy("traj_id", "tool_call_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    both = calls.withColumn("_result", F.lit(False)).unionByName(results.withColumn("_result", F.lit(True)))
    found = both.withColumn("_found", F.last("_name", ignorenulls=True).over(w)).where("_result").select("traj_id", "idx", F.coalesce("_found", F.lit("unknown")).alias("_name"))
    return rows.join(found, ["traj_id", "idx"], "left")


def drop_user_calls(messages: DataFrame) -> DataFrame:
    """Without the spans from a user message with a call in its text to the next user message without one."""
    calls = F.when(F.col("role") == "user", F.contains(text_or_empty(F.col("content")), F.lit(CALL_OPEN)))
    w = Window.partitionBy("traj_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_in", F.coalesce(F.last(calls, ignorenulls=True).over(w), F.lit(False))).where("NOT _in").drop("_in")


def with_system(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """A system message, idx -1, before the rows of each trajectory that has any; ``prompts``: traj_id, prompt."""
    first = rows.select("traj_id").distinct().join(prompts, "traj_id").select("traj_id", F.lit(-1).cast(rows.schema["idx"].dataType).alias("idx"), F.lit("system").alias("role"), F.col("prompt").alias("content"))
    return rows.select("traj_id", "idx", "role", "content").unionByName(first)


def nested(rows: DataFrame) -> DataFrame:
    """(traj_id, messages) from (traj_id, idx, role, content)."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "role", "content")))
    return rows.groupBy("traj_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def merged_responses(responses: Column) -> Column:
    """Result texts as one tool message: a single one as it is; of several the first without its opening tag and the last
    without its closing one."""
    return F.array_join(responses, f"\n{RESPONSE_CLOSE}\n{RESPONSE_OPEN}\n")


def decoded_history(history: Column, truncate: Column) -> Column:
    """(role, content) messages of a history of (role, content, tool_calls, responses); null if it cannot be used.

    With ``truncate`` the history ends at the assistant's last call, and one without any cannot be used; neither can one
    in which the user calls tools.  An assistant's text and calls become one text."""
    calls = lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0
    marked = F.transform(history, lambda m: m.withField("has_call", calls(m)))
    used = F.when(truncate, truncate_at_last_call(marked)).otherwise(marked)
    called = lambda m: F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit(CALL_OPEN), call_text(c["name"], c["arguments"]), F.lit(CALL_CLOSE))), "")
    said = lambda m: F.when(text_or_empty(m["content"]) == "", F.lit("")).otherwise(F.concat(m["content"], F.lit("\n")))
    content = lambda m: F.when(m["role"] == "tool", merged_responses(F.transform(m["responses"], lambda r: response_text(r["name"], r["content"])))).when((m["role"] == "assistant") & calls(m), strip_text(F.concat(said(m), called(m)))).otherwise(m["content"])
    refused = F.exists(used, lambda m: (m["role"] == "user") & calls(m))
    return F.when(used.isNotNull() & ~refused, F.transform(used, lambda m: F.struct(m["role"].alias("role"), content(m).alias("content"))))


def clean_trajectories(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """(traj_id, messages) of the runtime messages that may serve as clean training data: analysis removed, in training
    form, the system prompt without analysis, format and error recovery fine.  What fails a check is left out.

    ``rows`` as for ``training_rows``; ``prompts``: traj_id, prompt."""
    lists = rows.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content", "tool_call_id", "tool_calls"))).alias("m"))
    cleaned = lists.select("traj_id", F.explode(without_analysis(F.col("m"))).alias("m")).select("traj_id", "m.*")
    formatted = with_system(training_rows(cleaned), prompts.select("traj_id", clean_system_prompt(F.col("prompt")).alias("prompt")))
    return nested(formatted).where(extractor_format_ok(F.col("messages")) & recovery_ok(F.col("messages")))


# --- records ----------------------------------------------------------------------------------------------------------


def unified_record(records: DataFrame, domain: str) -> DataFrame:
    """Synthetic records (messages, tools as JSON text, statistics, user_info, task_data) with their metadata.  Tools stay
    as they are: they are text already."""
    meta = F.struct(F.lit("synthetic").alias("source"), F.lit(domain).alias("domain"), *[F.coalesce(F.col(c), F.lit("{}")).alias(c) for c in ("statistics", "user_info", "task_data")])
    return records.select("messages", F.coalesce("tools", F.lit("[]")).alias("tools"), meta.alias("metadata"))


def with_source(records: DataFrame, domain: str, source: str = "real") -> DataFrame:
    """``metadata`` with source and domain where a record has none."""
    own = F.struct(F.lit(source).alias("source"), F.lit(domain).alias("domain"))
    if "metadata" not in records.columns:
        return records.withColumn("metadata", own)
    fields = records.schema["metadata"].dataType.fieldNames()
    filled = F.struct(*[own[f].alias(f) if f in ("source", "domain") else F.lit(None).cast(records.schema["metadata"].dataType[f].dataType).alias(f) for f in fields])
    return records.withColumn("metadata", F.coalesce("metadata", filled))


def api_to_tool(api: Column) -> Column:
    """The tool form of an API's JSON (name, description, parameters{properties, required}), as JSON text."""
    field = lambda path, default: F.coalesce(F.get_json_object(api, path), F.lit(default))
    parameters = F.concat(F.lit('{"type": "object", "properties": '), field("$.parameters.properties", "{}"), F.lit(', "required": '), field("$.parameters.required", "[]"), F.lit("}"))
    function = F.concat(F.lit('{"name": '), _string(field("$.name", "unknown_function")), F.lit(', "description": '), _string(field("$.description", "")), F.lit(', "parameters": '), parameters, F.lit("}"))
    return F.concat(F.lit('{"type": "function", "function": '), function, F.lit("}"))


def to_turns(messages: Column) -> Column:
    """(role, content) as (from, value)."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))


def from_turns(turns: Column) -> Column:
    """(from, value) as (role, content)."""
    return F.transform(turns, lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content")))


def legacy_turns(turns: Column) -> Column:
    """Turns whose calls stand in one ``<tool_calls>`` list of {function: {name, arguments}}, with each call in its own
    tags behind the text before the list; turns of other roles go."""
    listed = lambda v: F.from_json(F.regexp_extract(v, r"(?s)<tool_calls>(.*?)</tool_calls>", 1), "array<struct<function:struct<name:string,arguments:string>>>")
    calls = lambda v: F.array_join(F.transform(listed(v), lambda c: F.concat(F.lit(CALL_OPEN), call_text(c["function"]["name"], c["function"]["arguments"]), F.lit(CALL_CLOSE))), "")
    text = lambda t: F.when((t["from"] == "assistant") & F.contains(t["value"], F.lit("<tool_calls>")), F.concat(F.substring_index(t["value"], "<tool_calls>", 1), calls(t["value"]))).otherwise(t["value"])
    return F.transform(F.filter(turns, lambda t: t["from"].isin("user", "assistant", "tool")), lambda t: F.struct(t["from"].alias("from"), text(t).alias("value")))


# --- tasks as seeds, patterns and prompts ------------------------------------------------------------------------------


def seeds(tasks: DataFrame, domain: str) -> DataFrame:
    """Tasks as seeds: (domain, task_id, user_info, task_description, expected_actions, constraints)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    info = F.struct(text("user_scenario.instructions.known_info").alias("known_info"), text("user_scenario.instructions.reason_for_call").alias("reason_for_call"), text("user_scenario.instructions.task_instructions").alias("additional_instructions"))
    actions = F.transform(
        "evaluation_criteria.actions",
        lambda a: F.struct(F.coalesce(a["name"], F.lit("")).alias("name"), F.coalesce(a["arguments"], F.lit("{}")).alias("arguments"), F.coalesce(a["sequence_order"], F.lit(NO_ORDER)).alias("sequence_order")),
    )
    return tasks.select(
        F.lit(domain).alias("domain"),
        F.coalesce("id", F.lit("unknown")).alias("task_id"),
        info.alias("user_info"),
        F.struct(text("description.purpose").alias("purpose"), text("description.notes").alias("notes")).alias("task_description"),
        F.coalesce(actions, F.array().cast("array<struct<name:string,arguments:string,sequence_order:int>>")).alias("expected_actions"),
        F.coalesce("evaluation_criteria.nl_assertions", F.array().cast("array<string>")).alias("constraints"),
    )


def _section(title: str, body: Column) -> Column:
    return F.when(text_or_empty(body) != "", F.concat(F.lit(f"\n**{title}:**\n"), body))


def seed_prompt(seed: DataFrame) -> Column:
    """A seed as a prompt; parts without content are left out.  Arguments keep the order of their JSON text."""
    shown = lambda a: F.array_join(F.transform(F.map_entries(json_map(a)), lambda e: F.concat(e["key"], F.lit("="), _shown(e["value"]))), ", ")
    line = lambda a: F.concat(F.lit("  - "), a["name"], F.lit("("), text_or_empty(shown(a["arguments"])), F.lit(")"))
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n**{title}:**\n"), F.array_join(items, "\n")))
    parts = [
        F.lit("## Task Seed (MUST FOLLOW)"),
        _section("User Known Info", F.col("user_info.known_info")),
        _section("Reason for Call", F.col("user_info.reason_for_call")),
        _section("Additional Instructions", F.col("user_info.additional_instructions")),
        listed("Expected Action Sequence (YOU MUST FOLLOW)", F.transform("expected_actions", line)),
        listed("Constraints", F.transform("constraints", lambda c: F.concat(F.lit("  - "), c))),
        _section("Task Purpose", F.col("task_description.purpose")),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _shown(value: Column) -> Column:
    from trajlake.functions.matching import bare

    return bare(value)


def task_patterns(tasks: DataFrame, domain: str) -> DataFrame:
    """Tasks as patterns: type, complexity, tools in order, texts; ``unknown_info`` may be text or {"items": [...]}."""
    instructions = "user_scenario.instructions"
    unknown = F.col(f"{instructions}.unknown_info")
    items = F.array_join(F.from_json(F.get_json_object(unknown, "$.items"), "array<string>"), ", ")
    actions = F.coalesce(F.size("evaluation_criteria.actions"), F.lit(0))
    return tasks.select(
        F.col("id").alias("task_id"),
        F.lit(domain).alias("domain"),
        task_type(F.col(f"{instructions}.reason_for_call")).alias("task_type"),
        complexity(actions).alias("complexity"),
        F.col("user_scenario.persona").alias("persona"),
        F.col(f"{instructions}.reason_for_call").alias("reason_for_call"),
        F.when(F.startswith(unknown, F.lit("{")), text_or_empty(items)).otherwise(text_or_empty(unknown)).alias("unknown_info"),
        F.transform("evaluation_criteria.actions", lambda a: a["name"]).alias("tool_sequence"),
        actions.alias("n_actions"),
    )


def system_prompt(base: Column, reasoning: Column | None = None, tools: Column | None = None, hints: Column | None = None, analysis: Column | None = None) -> Column:
    """A system prompt with what is given of: reasoning instructions, the hints (map of tool to text) of the tools at hand
    in the order of the map, and an earlier analysis."""
    parts = [base]
    if reasoning is not None:
        parts.append(reasoning)
    if tools is not None and hints is not None:
        known = F.filter(F.map_entries(hints), lambda e: F.array_contains(tools, e["key"]))
        text = F.array_join(F.transform(known, lambda e: F.concat(F.lit("**"), e["key"], F.lit("**:"), e["value"])), "\n\n")
        parts.append(F.when(text != "", F.concat(F.lit("\n## Tool-Specific Guidelines\n"), text)))
    if analysis is not None:
        parts.append(F.when(text_or_empty(analysis) != "", F.concat(F.lit("\n## Previous Analysis\n"), analysis, F.lit("\n\nFollow these suggestions in this attempt."))))
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def analysis_markdown(title: str, head: dict[str, Column], sections: dict[str, Column]) -> Column:
    """Markdown of an analysis: a heading, a list of facts, and sections (texts, or arrays as numbered lists).  Empty lines
    are left out; the heading of an empty section stays."""
    parts = [F.lit(f"## {title}")] + [F.concat(F.lit(f"- {k}: "), v) for k, v in head.items()]
    for name, body in sections.items():
        parts += [F.lit(f"### {name}"), body]
    return F.array_join(F.filter(F.array(*parts), lambda x: text_or_empty(x) != ""), "\n")


def failure_markdown(task_id: Column, attempt: Column, reward: Column, analysis: Column) -> Column:
    """``analysis``: JSON with failure_reasons, key_mistakes, improvement_suggestions, correct_approach."""
    a = F.from_json(analysis, "failure_reasons string, key_mistakes array<string>, improvement_suggestions array<string>, correct_approach string")
    return analysis_markdown(
        "Failure Analysis",
        {"Task ID": task_id, "Attempt": attempt.cast("string"), "Reward": F.format_string("%.2f", reward)},
        {"Failure Reasons": a["failure_reasons"], "Key Mistakes": _numbered_list(a["key_mistakes"]), "Improvement Suggestions": _numbered_list(a["improvement_suggestions"]), "Correct Approach Reference": a["correct_approach"]},
    )


def contrast_markdown(task_id: Column, attempt: Column, reward: Column, analysis: Column) -> Column:
    """``analysis``: JSON with divergence_point, failure_reasons, key_differences, correct_steps, critical_lessons."""
    a = F.from_json(analysis, "divergence_point string, failure_reasons string, key_differences array<string>, correct_steps array<string>, critical_lessons string")
    return analysis_markdown(
        "Contrast Analysis (Failed vs Successful)",
        {"Task ID": task_id, "Failed Attempt": attempt.cast("string"), "Reward": F.format_string("%.2f", reward)},
        {
            "Divergence Point": a["divergence_point"],
            "Why It Failed": a["failure_reasons"],
            "Key Differences from Successful Trajectory": _numbered_list(a["key_differences"]),
            "Correct Steps to Follow": _numbered_list(a["correct_steps"]),
            "Critical Lesson": a["critical_lessons"],
        },
    )
