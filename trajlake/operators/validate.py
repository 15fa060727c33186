"""Validators and filters.  Each gives a flag and its reasons; rows are dropped only where a caller asks for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.text import once, one_json_object, one_json_value, plausible_response, well_formed_calls

# Limits and rules of the formats.
BANNED_TOOLS = {"airline": ("list_all_airports",), "retail": ("list_all_products",), "telecom": ("list_all_plans",)}
MOST_SEARCHES, MOST_MESSAGES, MOST_CALLS = 5, 35, 12
UPDATE_WORDS, GET_WORDS, SEARCH_WORDS = "update|modify|change|edit", "get|fetch|retrieve|find|search", "search|list"
TURNS, LEAST_CALLS, MOST_HALLUCINATION, LEAST_QUALITY = (3, 30), 2, 0.3, 3
LEAST_REASON_CHARS, LEAST_INSTRUCTION_CHARS = 20, 30
# End of fixed values.


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null if none does."""
    start = F.when(checks[0][0], checks[0][1])
    return reduce(lambda c, k: c.when(k[0], k[1]), checks[1:], start)


def message_reason(role: Column, content: Column, call_name: Column, call_arguments: Column, result: Column) -> Column:
    """Why a message is malformed; null for a good one.  A call's arguments must be one JSON object."""
    empty = F.coalesce(F.trim(content), F.lit("")) == ""
    bad_call = F.contains(content, F.lit("<tool_call>")) & (call_name.isNull() | ~one_json_object(call_arguments))
    return first_reason((~role.isin("system", "user", "assistant", "tool") | role.isNull(), "bad role"), (empty, "empty content"), ((role == "assistant") & bad_call, "bad tool call"), ((role == "tool") & result.isNull(), "bad tool result"))


def trajectory_reasons(messages: DataFrame) -> DataFrame:
    """(traj_id, valid, reason): the first failing message decides.  Rows: traj_id, idx, role, reason (of the message)."""
    w = Window.partitionBy("traj_id").orderBy("idx")
    order = F.when((F.row_number().over(w) == 1) & (F.col("role") != "system"), "first message is not system")
    order = order.when((F.col("role") == "tool") & (F.coalesce(F.lag("role").over(w), F.lit("")) != "assistant"), "tool without assistant before it")
    judged = messages.withColumn("why", F.coalesce("reason", order))
    return judged.groupBy("traj_id").agg((F.count("why") == 0).alias("valid"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("idx"))).alias("reason"))


def sft_record_valid(messages: Column, tools: Column) -> Column:
    """Messages and tools are there, and tools is a JSON list (one strict value)."""
    return messages.isNotNull() & F.coalesce(F.json_array_length(tools) >= 0, F.lit(False)) & one_json_value(tools)


def extractor_format_ok(messages: Column) -> Column:
    """(role, content) messages may be extracted: a system message first, calls well formed, tool messages plausible."""
    call = lambda m: (m["role"] == "assistant") & F.coalesce(F.contains(m["content"], F.lit("<tool_call>")), F.lit(False))
    fine = lambda m: F.when(call(m), well_formed_calls(m["content"])).when(m["role"] == "tool", plausible_response(m["content"])).otherwise(True)
    return F.coalesce((F.size(messages) > 0) & (F.get(messages, F.lit(0))["role"] == "system") & F.forall(messages, fine), F.lit(False))


def recovery_ok(messages: Column, most_errors: int = 8, most_in_a_row: int = 3) -> Column:
    """The array form of ``sequence.recovery_check``'s verdict, over (role, content) messages."""
    from trajlake.functions.text import is_error_response
    from trajlake.operators.sequence import longest_error_run

    bad = lambda m: (m["role"] == "tool") & is_error_response(m["content"])
    flags = F.transform(F.filter(messages, lambda m: m["role"] == "tool"), lambda m: is_error_response(m["content"]))
    answered = F.forall(F.transform(messages, lambda m, i: ~bad(m) | (F.coalesce(F.get(messages, i + 1)["role"], F.lit("assistant")) == "assistant")), lambda x: x)
    return (F.size(F.filter(flags, lambda x: x)) <= most_errors) & (longest_error_run(flags) <= most_in_a_row) & answered


def action_sequence_reasons(names: Column, n_messages: Column, domain: Column) -> Column:
    """All reasons against a sequence of call names."""
    lower = lambda x: F.lower(x)
    banned = F.lit(False)
    for name, tools in BANNED_TOOLS.items():
        banned = banned | ((domain == name) & F.arrays_overlap(names, F.array(*map(F.lit, tools))))
    searches = F.size(F.filter(names, lambda n: lower(n).rlike(SEARCH_WORDS)))
    get_at = F.array_min(F.transform(names, lambda n, i: F.when(lower(n).rlike(GET_WORDS), i)))
    update_at = F.array_min(F.transform(names, lambda n, i: F.when(lower(n).rlike(UPDATE_WORDS), i)))
    unfounded = update_at.isNotNull() & (get_at.isNull() | (get_at >= update_at))
    checks = ((banned, "banned tool"), (searches > MOST_SEARCHES, "too many searches"), (unfounded, "update before get"), (n_messages > MOST_MESSAGES, "too many messages"), (F.size(names) > MOST_CALLS, "too many calls"))
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))


def style_reasons(messages: Column, verbose_share: float = 1.0, most_chars: int = 99999, most_confirmations: int | None = None) -> Column:
    """Style rules over (role, content, has_call); the defaults are those of the format and never fire."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    calls = F.filter(own, lambda m: m["has_call"])
    wordy = F.filter(calls, lambda m: F.trim(F.regexp_replace(m["content"], r"(?s)<tool_call>.*?</tool_call>", "")) != "")
    checks = [(F.size(wordy) > verbose_share * F.size(calls), "verbose calls"), (F.exists(own, lambda m: F.length(m["content"]) > most_chars), "long reply")]
    if most_confirmations is not None:
        asks = F.filter(own, lambda m: F.lower(m["content"]).rlike(r"(would you like|do you want|shall i|please confirm)"))
        checks.append((F.size(asks) > most_confirmations, "redundant confirmations"))
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))


def quality_filter_reason(turns: Column, calls: Column, hallucinations: Column, quality: Column) -> Column:
    """The first reason to reject a synthetic record; null to keep it.  A missing quality counts as 5."""
    return first_reason(
        (turns < TURNS[0], "too few turns"),
        (turns > TURNS[1], "too many turns"),
        (calls < LEAST_CALLS, "too few calls"),
        ((calls > 0) & (F.coalesce(hallucinations, F.lit(0)) > MOST_HALLUCINATION * calls), "hallucination rate"),
        (F.coalesce(quality, F.lit(5)) < LEAST_QUALITY, "low quality"),
    )


def task_score(missing_top: Column, missing_scenario: Column, missing_instructions: Column, missing_criteria: Column, reason: Column, instructions: Column, actions: Column, unnamed: Column, unargued: Column, assertions: Column) -> Column:
    """Score of a task: 1 less fixed deductions, 0 at least.  Missing top-level fields end the check."""
    short = lambda text, least: (F.length(F.coalesce(text, F.lit(""))) < least).cast("int")
    rest = 100 - 10 * (missing_scenario + missing_instructions + missing_criteria)
    rest = rest - 5 * (short(reason, LEAST_REASON_CHARS) + short(instructions, LEAST_INSTRUCTION_CHARS))
    rest = rest - 10 * (actions == 0).cast("int") - 5 * unnamed - 2 * unargued - 5 * (assertions == 0).cast("int")
    return F.greatest(F.lit(0), F.when(missing_top > 0, 100 - 25 * missing_top).otherwise(rest)) / 100


def schema_problems(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """Calls against the tool schema: (call columns, problem).  ``calls``: call_id, name, arguments map; ``schema``: tool,
    param, required.  A call can have several problems; one without any is not returned."""
    tools = schema.groupBy("tool").agg(F.collect_set("param").alias("params"), F.collect_set(F.when(F.col("required"), F.col("param"))).alias("needed"))
    joined = calls.join(tools, calls["name"] == tools["tool"], "left")
    unknown = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array().cast("array<string>"))
    extra = F.transform(F.array_except(F.map_keys("arguments"), F.coalesce("params", F.array().cast("array<string>"))), lambda p: F.concat(F.lit("unknown parameter "), p))
    missing = F.transform(F.array_except(F.coalesce("needed", F.array().cast("array<string>")), F.map_keys("arguments")), lambda p: F.concat(F.lit("missing parameter "), p))
    known = F.col("tool").isNotNull()
    empty = F.array().cast("array<string>")
    return joined.withColumn("problem", F.explode(F.concat(unknown, F.when(known, extra).otherwise(empty), F.when(known, missing).otherwise(empty)))).drop("tool", "params", "needed")


def dimension_gate(scores: Column, threshold: int) -> Column:
    """Every score, clamped to 1..5, reaches the threshold."""
    return F.forall(scores, lambda s: F.least(F.lit(5), F.greatest(F.lit(1), s.cast("int"))) >= threshold)


def same_format(original: Column, changed: Column) -> Column:
    """A changed identifier keeps the form of the original (the four id patterns)."""
    checks = [r"^#W\d+$", r"^[A-Z0-9]{6}$", r"^[a-z]+_[a-z]+_\d+$", r"^[LPBCD]\d{4,}$"]
    return reduce(lambda a, p: a & (~original.rlike(p) | changed.rlike(p)), checks, F.lit(True))


# Required parts of a task and of generated users and tasks.
TASK_FIELDS = {"id": "string", "description": "object", "user_scenario": "object", "evaluation_criteria": "object"}
SCENARIO_FIELDS = {"persona": "string", "instructions": "object"}
INSTRUCTION_FIELDS = ("domain", "reason_for_call", "known_info", "task_instructions")
CRITERIA_FIELDS = ("actions", "nl_assertions")
USER_FIELDS = ("user_profile", "known_info", "unknown_info", "user_need", "difficulty_design")
MOST_ROUNDS, MOST_UNKNOWN = 5, 5
# End of fixed values.


def _kind(json: Column) -> Column:
    """string, object, list or other, from a value's JSON text."""
    return F.when(F.startswith(json, F.lit('"')), "string").when(F.startswith(json, F.lit("{")), "object").when(F.startswith(json, F.lit("[")), "list").otherwise("other")


def task_check(task: Column) -> Column:
    """(valid, score, errors, warnings) of a task's JSON text.

    Missing or mistyped top-level fields end the check: 25 and 10 hundredths each.  Below them a missing part costs 10, a
    mistyped one 5, a short text 5, no actions 10, an action that is no object or has no name 5, one without arguments 2,
    no assertions 5.  Text that is no JSON object lacks every field."""
    from trajlake.functions.matching import json_values

    none = F.lit(None).cast("map<string,variant>")
    part = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("map<string,variant>")
    texts_of = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)).try_cast("array<string>"), F.array().cast("array<string>"))

    def level1(top: Column) -> Column:
        return once(F.struct(top.alias("top"), part(top, "user_scenario").alias("scenario"), part(top, "evaluation_criteria").alias("criteria")), level2)

    def level2(v: Column) -> Column:
        actions = texts_of(v["criteria"], "actions")
        parts = [v["top"].alias("top"), v["scenario"].alias("scenario"), v["criteria"].alias("criteria"), part(v["scenario"], "instructions").alias("instructions"), actions.alias("actions"), F.size(texts_of(v["criteria"], "nl_assertions")).alias("n_assertions")]
        return once(F.struct(*parts), counted)

    def counted(v: Column) -> Column:
        keys = F.transform(F.filter(v["actions"], lambda a: F.startswith(a, F.lit("{"))), lambda a: F.json_object_keys(a))
        return once(keys, lambda objects: odd(v, objects))

    def odd(v: Column, objects: Column) -> Column:
        without = lambda k: F.size(F.filter(objects, lambda o: ~F.array_contains(o, F.lit(k))))
        numbers = F.struct((F.size(v["actions"]) - F.size(objects)).alias("strange"), without("name").alias("unnamed"), without("arguments").alias("unargued"))
        return once(numbers, lambda n: _task_verdict(v, n))

    return once(F.coalesce(json_values(task), none), level1)


def _task_verdict(v: Column, n: Column) -> Column:
    """The verdict of ``task_check`` from a task's parts (maps of variants, null for no object) and the numbers of its odd
    actions.  Every rule is tried once: it leaves its cost and text where it is broken."""
    lacks = lambda m, k: ~F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))
    kind_of = lambda m, k: _kind(F.to_json(F.try_element_at(m, F.lit(k))))
    short = lambda k, least: F.length(F.coalesce(F.try_element_at(v["instructions"], F.lit(k)).try_cast("string"), F.lit(""))) < least
    broke = lambda cost, text: F.struct(F.lit(cost).alias("cost"), F.lit(text).alias("text"))
    found = lambda rules: F.array_compact(F.array(*rules))
    cost = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x["cost"])
    texts = lambda some: F.transform(some, lambda x: x["text"])

    def typed(m: Column, k: str, kind: str, name: str, missing: tuple[int, str], mistyped: int) -> Column:
        return F.when(lacks(m, k), broke(*missing)).when(kind_of(m, k) != kind, broke(mistyped, f"{name} should be {kind}"))

    head = [typed(v["top"], k, kind, f"Field {k}", (25, f"Missing required field: {k}"), 10) for k, kind in TASK_FIELDS.items()]
    errors = [typed(v["scenario"], k, kind, f"user_scenario.{k}", (10, f"Missing user_scenario.{k}"), 5) for k, kind in SCENARIO_FIELDS.items()]
    errors += [F.when(lacks(v["instructions"], k), broke(10, f"Missing instructions.{k}")) for k in INSTRUCTION_FIELDS]
    errors += [F.when(lacks(v["criteria"], k), broke(10, f"Missing evaluation_criteria.{k}")) for k in CRITERIA_FIELDS]
    warnings = [F.when(short("reason_for_call", LEAST_REASON_CHARS), broke(5, "reason_for_call too short")), F.when(short("task_instructions", LEAST_INSTRUCTION_CHARS), broke(5, "task_instructions too short"))]
    warnings += [F.when(F.size(v["actions"]) == 0, broke(10, "actions is empty")), F.when(v["n_assertions"] == 0, broke(5, "nl_assertions is empty"))]
    of = lambda c, each, text: F.when(c > 0, F.struct((each * c).alias("cost"), F.concat(c.cast("string"), F.lit(text)).alias("text")))
    errors += [of(n["strange"], 5, " actions are no objects"), of(n["unnamed"], 5, " actions without name")]
    warnings += [of(n["unargued"], 2, " actions without arguments")]

    def verdict(x: Column) -> Column:
        score = F.greatest(F.lit(0), 100 - cost(x["errors"]) - cost(x["warnings"])) / 100
        return F.struct((F.size(x["errors"]) == 0).alias("valid"), score.alias("score"), texts(x["errors"]).alias("errors"), texts(x["warnings"]).alias("warnings"))

    def below(top: Column) -> Column:
        broken = F.size(top) > 0
        none = F.filter(top, lambda x: F.lit(False))
        return once(F.struct(F.when(broken, top).otherwise(found(errors)).alias("errors"), F.when(broken, none).otherwise(found(warnings)).alias("warnings")), verdict)

    return once(found(head), below)


def user_info_problem(info: Column) -> Column:
    """The first thing wrong with a generated user's JSON text; null if nothing is."""
    from trajlake.functions.matching import json_map

    items = F.coalesce(F.json_array_length(F.get_json_object(info, "$.unknown_info.items")), F.lit(0))

    def reason(m: Column) -> Column:
        missing = [(~F.map_contains_key(m, F.lit(k)), f"Missing {k}") for k in USER_FIELDS]
        return first_reason(*missing, (items < 1, "unknown_info has no items"), (items > MOST_UNKNOWN, "unknown_info has too many items"))

    return once(F.coalesce(json_map(info), F.create_map().cast("map<string,string>")), reason)


def task_structure_problem(task: Column) -> Column:
    """The first thing wrong with a generated task's JSON text (title, task_rounds, dependencies); null if nothing is.

    One to five rounds, each with round_index, user_goal and a list tools_needed whose tools have a name; dependencies
    name rounds that exist, and one without both ends is passed over."""
    from trajlake.functions.matching import json_map

    none = F.create_map().cast("map<string,string>")
    lists = lambda m, k: F.from_json(F.try_element_at(m, F.lit(k)), "array<string>")
    keyed = lambda m: F.transform(lists(m, "task_rounds"), lambda r: F.coalesce(json_map(r), none))
    ends = lambda m: F.from_json(F.try_element_at(m, F.lit("dependencies")), "array<struct<from_round:int,to_round:int>>")
    parts = lambda m: F.struct(m.alias("m"), keyed(m).alias("rounds"), ends(m).alias("ends"))
    return once(F.coalesce(json_map(task), none), lambda m: once(parts(m), _structure_reason))


def _structure_reason(v: Column) -> Column:
    rounds = v["rounds"]
    lacks = lambda k: F.exists(rounds, lambda r: ~F.map_contains_key(r, F.lit(k)))
    tools = lambda r: F.try_element_at(r, F.lit("tools_needed"))
    unnamed = F.exists(rounds, lambda r: F.exists(F.from_json(tools(r), "array<string>"), lambda t: ~F.coalesce(F.array_contains(F.json_object_keys(t), F.lit("tool_name")), F.lit(False))))
    outside = lambda x: (x < 1) | (x > F.size(rounds))
    loose = F.exists(v["ends"], lambda e: e["from_round"].isNotNull() & e["to_round"].isNotNull() & (outside(e["from_round"]) | outside(e["to_round"])))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return first_reason(
        (~F.map_contains_key(v["m"], F.lit("title")), "Missing title"),
        (~F.map_contains_key(v["m"], F.lit("task_rounds")), "Missing task_rounds"),
        (~yes((F.size(rounds) >= 1) & (F.size(rounds) <= MOST_ROUNDS)), "not 1 to 5 rounds"),
        (yes(lacks("round_index")), "Missing round_index"),
        (yes(lacks("user_goal")), "Missing user_goal"),
        (yes(lacks("tools_needed")), "Missing tools_needed"),
        (yes(F.exists(rounds, lambda r: _kind(tools(r)) != "list")), "tools_needed is no list"),
        (yes(unnamed), "tool without name"),
        (yes(loose), "dependency outside the rounds"),
    )
