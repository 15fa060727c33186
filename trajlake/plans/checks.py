"""Registered queries over checks, faults, reports and samples, each with its SQL.

Where an operator's cases do not occur in the tables, the rows deal out a list of cases with the result that each must
have; the SQL deals out the results.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlake.functions import matching, scoring, text
from trajlake.operators import faults, generate, inject, provider, reports, sampling, sequence, validate
from trajlake.plans.adapters import conversation_messages, event_messages, labelled_runs, order_actions, table
from trajlake.plans.registry import choice, m_sql, query, sql_choice, u_sql


def cases(rows, names: str, key: str = "event_id") -> str:
    """SQL columns that deal out the results of cases: the values behind the first of each."""
    return ", ".join(f"{sql_choice([r[k + 1] for r in rows], f'{key} % {len(rows)}')} AS {n}" for k, n in enumerate(names.split()))


def case(rows, key: str = "event_id", at: int = 0):
    return choice([r[at] for r in rows], F.col(key) % len(rows))


# --- messages and texts -----------------------------------------------------------------------------------------------------

#: Tool messages of every kind: text, strict error, error response, any "Error:", name if one object with a name, plausible.
RESPONSES = (
    ('{"name": "t", "result": "Error: x"}', True, True, True, "t", True),
    ('{"name": "t", "result": "Error: x"}{"name": "u", "result": "ok"}', False, False, True, None, True),
    ('{"result": "Error: y"}', True, True, True, None, True),
    ("Error: plain", False, True, True, None, True),
    ('{"name": "t", "result": "fine"}', False, False, False, "t", True),
    ('{"name": "t", "result": {"a": [1]}}', False, False, False, "t", True),
    ('{"name": "t", "result": "cut o', False, False, False, None, True),
    ('{"neither', False, False, False, None, False),
    ("", False, False, False, None, False),
    ('{"name": "t", "result": "Error: x"} and more', False, False, True, None, True),
)


@query(f"SELECT event_id, {cases(RESPONSES, 'strict_error error_response any_error tool plausible')} FROM events")
def tool_response_kinds(spark, d):
    """The predicates over one object, several in a row, cut-off and plain texts."""
    c = case(RESPONSES)
    return table(spark, d, "events").select(
        "event_id", text.is_error_result(c).alias("strict_error"), text.is_error_response(c).alias("error_response"), text.contains_error(c).alias("any_error"), text.tool_response(c, need_name=True)["name"].alias("tool"), text.plausible_response(c).alias("plausible")
    )


#: Texts: placeholder, stop signal, analysis, connection error, domain as a path.
TEXTS = (
    ("<USER_ID>", True, False, False, False, "unknown"),
    ("x {{name}} y", True, False, False, False, "unknown"),
    ("PAYMENT_METHOD_ID", True, False, False, False, "unknown"),
    ('["a", "<b>"]', True, False, False, False, "unknown"),
    ('["A_LONG_NAME_X", "{{b}}"]', False, False, False, False, "unknown"),
    ("SHORT_ID", False, False, False, False, "unknown"),
    ("thanks ###STOP###", False, True, False, False, "unknown"),
    ("[STOP]", False, True, False, False, "unknown"),
    ("ok\n### Why It Failed", False, False, True, False, "unknown"),
    ("Connection refused", False, False, False, True, "unknown"),
    ("HTTP 503", False, False, False, True, "unknown"),
    ("runs/retail/airline_1.json", False, False, False, False, "airline"),
    ("telecom.toml", False, False, False, False, "telecom"),
)


@query(f"SELECT event_id, {cases(TEXTS, 'placeholder stops analysis connection domain')} FROM events")
def text_predicates(spark, d):
    c = case(TEXTS)
    return table(spark, d, "events").select("event_id", text.has_placeholder(c).alias("placeholder"), text.has_stop_signal(c).alias("stops"), text.has_analysis(c).alias("analysis"), text.is_connection_error(c).alias("connection"), text.domain_of_path(c).alias("domain"))


#: Messages and their templates, with every pattern.
TEMPLATED = (
    ("user mia_li_22 unknown", "user {user_id} unknown"),
    ("order #W1234567 is gone", "order {order_id} is gone"),
    ("code ABCDEF is used", "code {reservation_id} is used"),
    ("flight HAT123 left", "flight {flight_number} left"),
    ("line P1001 is down", "line {phone_number} is down"),
    ("customer C77 left", "customer {customer_id} left"),
    ("item 1234567890 sold", "item {product_id} sold"),
    ("on 2024-05-15 at noon", "on {date} at noon"),
    ("pay 12 now", "pay {amount} now"),
    ("plain words", "plain words"),
)
#: Texts and what cleaning makes of them: prompt, analysis cut, fences off, first object, first array, provider off, sentences.
CLEANED = (
    ("base\n## Contrast Analysis x", "base", "base", "base\n## Contrast Analysis x", "", "", "base\n## Contrast Analysis x", 1),
    ('```json\n{"a": 1}\n```', '```json\n{"a": 1}\n```', '```json\n{"a": 1}\n```', '{"a": 1}', '{"a": 1}', "", '```json\n{"a": 1}\n```', 1),
    ("say [1, [2]] of openai/gpt", "say [1, [2]] of openai/gpt", "say [1, [2]] of openai/gpt", "say [1, [2]] of openai/gpt", "", "[1, [2]]", "gpt", 1),
    ("One. Two. . Three", "One. Two. . Three", "One. Two. . Three", "One. Two. . Three", "", "", "One. Two. . Three", 3),
)


@query(f"SELECT event_id, {cases(TEMPLATED, 'template')}, {cases(CLEANED, 'prompt analysis fence object array model sentences')} FROM events")
def text_cleaning(spark, d):
    """Templates by all nine patterns, and every way of cleaning a text."""
    c = case(CLEANED)
    return table(spark, d, "events").select(
        "event_id", text.error_template(case(TEMPLATED)).alias("template"), text.clean_system_prompt(c).alias("prompt"), text.cut_analysis(c).alias("analysis"), text.strip_code_fence(c).alias("fence"), text.outer_object(c).alias("object"), text.outer_array(c).alias("array"), text.without_model_prefix(c).alias("model"), text.sentence_count(c).alias("sentences")
    )


@query("SELECT p_partkey, 'of ' || p_brand || ' for 100 at unknown' AS filled, CASE WHEN p_partkey % 2 = 0 THEN 'use ' || p_brand ELSE 'Something went wrong with that call; I will correct it and retry with the right parameters.' END AS safe FROM part")
def template_defaults(spark, d):
    values = F.create_map(F.lit("brand"), F.col("p_brand"))
    defaults = F.create_map(F.lit("amount"), F.lit("100"), F.lit("brand"), F.lit("none"))
    template = F.when(F.col("p_partkey") % 2 == 0, "use {brand}").otherwise("use {brand} and {more}")
    return table(spark, d, "part").select("p_partkey", text.fill_with_defaults(F.lit("of {brand} for {amount} at {place}"), values, defaults).alias("filled"), text.format_safe(template, values).alias("safe"))


# --- validators ---------------------------------------------------------------------------------------------------------------

MESSAGE_RULES = """x AS (SELECT traj_id, idx, role, CASE WHEN kind = 'text' AND event_id % 17 = 0 THEN 'empty content' WHEN kind = 'call' AND event_id % 11 = 0 THEN 'bad tool call' WHEN kind = 'result' AND event_id % 19 = 0 THEN 'bad tool result' END AS why FROM evt),
 y AS (SELECT *, coalesce(why, CASE WHEN role = 'tool' AND coalesce(lag(role) OVER (PARTITION BY traj_id ORDER BY idx), 'system') <> 'assistant' THEN 'tool without assistant before it' END) AS reason FROM x)"""


@query(f"WITH {MESSAGE_RULES} SELECT traj_id, count(reason) = 0 AS valid, arg_min(reason, idx) FILTER (reason IS NOT NULL) AS reason FROM y GROUP BY traj_id", "evt")
def first_failure_reason(spark, d):
    """Messages behind a system message; some texts are empty, some calls hold a list for arguments, some results no result."""
    rows = event_messages(spark, d)
    bad_call = F.concat(F.lit('<tool_call>{"name": "'), "name", F.lit('", "arguments": [1]}</tool_call>'))
    every = lambda kind, n: (F.col("kind") == kind) & (F.col("event_id") % n == 0)
    content = F.when(every("text", 17), F.lit(" ")).when(every("call", 11), bad_call).when(every("result", 19), F.lit('{"name": "x"}')).otherwise(F.col("content"))
    rows = rows.select("traj_id", F.col("idx").cast("long").alias("idx"), "role", content.alias("content"))
    rows = rows.unionByName(rows.select("traj_id").distinct().select("traj_id", F.lit(-1).cast("long").alias("idx"), F.lit("system").alias("role"), F.lit("s").alias("content")))
    call, result = text.first_tool_call(F.col("content")), text.response_result(F.col("content"))
    return validate.trajectory_reasons(rows.withColumn("reason", validate.message_reason(F.col("role"), F.col("content"), call["name"], call["arguments"], result)))


TASK_PIECES = """t AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS persona, o_orderkey % 3 = 0 AS long, o_orderkey % 5 = 0 AS broken, o_orderkey % 7 AS n, o_orderkey % 11 <> 0 AS text_id FROM orders),
 c AS (SELECT k, CASE WHEN broken OR NOT text_id THEN 100 - 25 * broken::INT - 10 * (NOT text_id)::INT ELSE 100 - 10 * (NOT persona)::INT - 5 * (NOT long)::INT - 5 - 10 * (n = 0)::INT - 2 * (n > 1)::INT - 5 * (n > 3)::INT END / 100 AS score,
 CASE WHEN broken OR NOT text_id THEN broken::INT + (NOT text_id)::INT ELSE (NOT persona)::INT + (n > 3)::INT END AS n_errors FROM t)"""


def _task_json(spark, d):
    """Orders as tasks in JSON: some lack the criteria or the persona, some have a number for an id, most reasons are short,
    and some actions lack a name or arguments."""
    k = F.col("o_orderkey")
    reason = F.when(k % 3 == 0, "a reason of more than twenty characters").otherwise("short")
    n = k % 7
    actions = F.array_join(F.array_compact(F.array(F.when(n > 0, '{"name": "a", "arguments": {}}'), F.when(n > 1, '{"name": "b"}'), F.when(n > 3, '{"arguments": {}}'))), ", ")
    instructions = F.concat(F.lit('{"domain": "shop", "reason_for_call": "'), reason, F.lit('", "known_info": "", "task_instructions": "short"}'))
    scenario = F.concat(F.lit("{"), F.when(k % 2 == 0, '"persona": "calm", ').otherwise(""), F.lit('"instructions": '), instructions, F.lit("}"))
    criteria = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(', "evaluation_criteria": {"actions": ['), actions, F.lit('], "nl_assertions": ["x"]}')))
    ids = F.when(k % 11 != 0, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(k.cast("string"))
    return table(spark, d, "orders").select(k.alias("k"), validate.task_check(F.concat(F.lit('{"id": '), ids, F.lit(', "description": {}, "user_scenario": '), scenario, criteria, F.lit("}"))).alias("c"))


@query(f"WITH {TASK_PIECES} SELECT k, n_errors = 0 AS valid, score, n_errors FROM c")
def task_structure_score(spark, d):
    return _task_json(spark, d).select("k", "c.valid", "c.score", F.size("c.errors").alias("n_errors"))


@query(f"WITH {TASK_PIECES} SELECT count(*) AS total_tasks, count(*) FILTER (n_errors = 0) AS valid_tasks, count(*) FILTER (n_errors > 0) AS invalid_tasks, round(avg(score), 9) AS average_score, round(count(*) FILTER (n_errors = 0) / count(*), 9) AS pass_rate FROM c")
def task_batch_report(spark, d):
    out = reports.batch_report(_task_json(spark, d).select("c.valid", "c.score"))
    return out.select("total_tasks", "valid_tasks", "invalid_tasks", F.round("average_score", 9).alias("average_score"), F.round("pass_rate", 9).alias("pass_rate"))


_USER = '"known_info": {}, "unknown_info": {"items": %s}, "user_need": "", "difficulty_design": {}}'
USER_INFOS = (
    ('{"user_profile": {}, ' + _USER % "[1]", None),
    ("{" + _USER % "[1]", "Missing user_profile"),
    ('{"user_profile": {}, ' + _USER % "[]", "unknown_info has no items"),
    ('{"user_profile": {}, ' + _USER % "[1, 2, 3, 4, 5, 6]", "unknown_info has too many items"),
    ("no json", "Missing user_profile"),
)
_ROUND = '{"round_index": 1, "user_goal": "g", "tools_needed": [{"tool_name": "t"}]}'
TASK_ROUNDS = (
    ('{"title": "t", "task_rounds": [' + _ROUND + '], "dependencies": [{"from_round": 1, "to_round": 1}, {"to_round": 9}]}', None),
    ('{"task_rounds": []}', "Missing title"),
    ('{"title": "t"}', "Missing task_rounds"),
    ('{"title": "t", "task_rounds": []}', "not 1 to 5 rounds"),
    ('{"title": "t", "task_rounds": [' + ", ".join([_ROUND] * 6) + "]}", "not 1 to 5 rounds"),
    ('{"title": "t", "task_rounds": [{"user_goal": "g", "tools_needed": []}]}', "Missing round_index"),
    ('{"title": "t", "task_rounds": [{"round_index": 1, "user_goal": "g"}]}', "Missing tools_needed"),
    ('{"title": "t", "task_rounds": [{"round_index": 1, "user_goal": "g", "tools_needed": {}}]}', "tools_needed is no list"),
    ('{"title": "t", "task_rounds": [{"round_index": 1, "user_goal": "g", "tools_needed": [{"name": "t"}]}]}', "tool without name"),
    ('{"title": "t", "task_rounds": [' + _ROUND + '], "dependencies": [{"from_round": 1, "to_round": 2}]}', "dependency outside the rounds"),
)


@query(f"SELECT event_id, {cases(USER_INFOS, 'user_problem')}, {cases(TASK_ROUNDS, 'task_problem')} FROM events")
def generated_structure_checks(spark, d):
    return table(spark, d, "events").select("event_id", validate.user_info_problem(case(USER_INFOS)).alias("user_problem"), validate.task_structure_problem(case(TASK_ROUNDS)).alias("task_problem"))


#: Training records: messages there, tools, valid.
RECORDS = ((True, "[]", True), (True, '[{"a": 1}]', True), (True, "{}", False), (True, "[][]", False), (True, None, False), (False, "[]", False))
#: Styles: has a call with words before it, questions asked, reasons at strict settings.
STYLES = (("plain", ""), ("wordy", "verbose calls"), ("asks", "redundant confirmations"), ("long", "long reply"))


@query(f"SELECT event_id, {sql_choice([r[2] for r in RECORDS], f'event_id % {len(RECORDS)}')} AS valid, {cases(STYLES, 'style')}, event_id % 7 >= 2 AS passes, event_id % 4 < 2 AS same, event_id % 2 = 0 AS listed, {sql_choice([100, 150, 180, 180], 'event_id % 4')} AS steps FROM events")
def record_checks(spark, d):
    """Records, styles, score gates, formats kept, lists as sets, and step limits, case by case."""
    message = "array<struct<role:string,content:string>>"
    there = choice([r[0] for r in RECORDS], F.col("event_id") % len(RECORDS), "boolean")
    valid = validate.sft_record_valid(F.when(there, F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).cast(message)), case(RECORDS, at=1))
    kind = case(STYLES)
    said = lambda content, call: F.struct(F.lit("assistant").alias("role"), content.alias("content"), call.alias("has_call"))
    call = F.when(kind == "wordy", 'now <tool_call>{"a": 1}</tool_call>').otherwise('<tool_call>{"a": 1}</tool_call>')
    talk = F.when(kind == "asks", "Shall I go on?").when(kind == "long", F.repeat(F.lit("x"), 40)).otherwise("done")
    style = F.array_join(validate.style_reasons(F.array(said(call, F.lit(True)), said(talk, F.lit(False))), 0.2, 35, 0), ",")
    passes = validate.dimension_gate(F.array(F.lit(9.7), F.col("event_id") % 7, F.lit(5.0)), 2)
    four = F.col("event_id") % 4
    same = validate.same_format(choice(("#W12", "ABC123", "L1001", "mia_li_2"), four), choice(("#W99", "ABC129", "L1", "mia"), four))
    listed = matching.list_values_match(F.array(F.lit("A"), F.lit("b")), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("B"), F.lit("a"))).otherwise(F.array(F.lit("a"))))
    steps = scoring.adjusted_max_steps(F.when(four == 3, 150).otherwise(100), four.isin(1, 2), four.isin(2, 3))
    return table(spark, d, "events").select("event_id", valid.alias("valid"), style.alias("style"), passes.alias("passes"), same.alias("same"), listed.alias("listed"), steps.alias("steps"))


QUALITY = """WITH t AS (SELECT task_id, count(*) AS n, count(DISTINCT name) AS kinds, count(*) FILTER (called) AS done, count(*) FILTER (discount > 5) AS talk FROM ord GROUP BY task_id),
 q AS (SELECT task_id, round(0.4 * (done / n) + 0.4 * (1.0 / kinds) + 0.2 * least(talk / 3, 1.0), 9) AS score FROM t)"""


@query(f"{QUALITY} SELECT task_id, score FROM q WHERE score >= 0.7", "ord")
def gate_by_quality(spark, d):
    t = order_actions(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("kinds"), F.count_if("called").alias("done"), F.count_if(F.col("discount") > 5).alias("talk"))
    scored = t.select("task_id", F.round(scoring.quality_score_v1(F.col("done") / F.col("n"), 1.0 / F.col("kinds"), F.col("talk")), 9).alias("score"))
    return reports.gate(scored, "score", 0.7)


@query("WITH c AS (SELECT DISTINCT task_id, name FROM ord WHERE called) SELECT o.task_id, count(c.name) / count(*) AS completeness FROM ord o LEFT JOIN c ON c.task_id = o.task_id AND c.name = o.name GROUP BY o.task_id", "ord")
def completeness_semi_match(spark, d):
    t = order_actions(spark, d).groupBy("task_id").agg(F.collect_list("name").alias("e"), F.collect_set(F.when(F.col("called"), F.col("name"))).alias("c"))
    return t.select("task_id", reports.completeness(F.col("e"), F.col("c")).alias("completeness"))


@query("SELECT traj_id, count(*) FILTER (name = 'click') AS searches, count(*) FILTER (name = 'click') > 5 AS over_budget FROM evt GROUP BY traj_id", "evt")
def search_budget(spark, d):
    calls = event_messages(spark, d).groupBy("traj_id").agg(F.collect_list(F.when(F.col("name") == "click", "Search_items").when(F.col("kind") == "call", "get_user")).alias("n"))
    over = F.array_contains(validate.action_sequence_reasons(F.col("n"), F.lit(1), F.lit("retail")), "too many searches")
    return calls.select("traj_id", F.size(F.filter("n", lambda x: F.lower(x).rlike("search|list"))).cast("long").alias("searches"), over.alias("over_budget"))


@query("SELECT task_id, count(*) FILTER (name = 'RF') AS n_weak, count(*) FILTER (name IN ('RF', 'NO')) AS n_sensitive FROM ord GROUP BY task_id", "ord")
def tool_kind_counts(spark, d):
    kinds = spark.createDataFrame([("shop", "RF", "weak"), ("shop", "RF", "sensitive"), ("shop", "NO", "sensitive"), ("bank", "NF", "weak")], "domain string, tool string, kind string")
    tasks = order_actions(spark, d).groupBy("task_id").agg(F.collect_list("name").alias("tools")).withColumn("domain", F.lit("shop"))
    return reports.tools_of_kinds(tasks, kinds)


@query(
    """WITH o AS (SELECT task_id, pos, name, quantity, discount, coalesce(CASE WHEN called THEN discount END, 999) AS place FROM ord), e AS (SELECT task_id, string_agg(name, '>' ORDER BY place, pos, name, quantity, discount) AS names FROM o GROUP BY task_id)
 SELECT task_id, names, CASE WHEN names LIKE 'R%' THEN 1.0 ELSE 0.0 END AS reward FROM e""",
    "ord",
)
def sequence_order_names(spark, d):
    """Actions by their order (999 where they have none), and the reward of an in-order match of the first letter."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "quantity", "discount", F.when(F.col("called"), F.col("discount").cast("int")).alias("sequence_order"))))
    ordered = order_actions(spark, d).groupBy("task_id").agg(sequence.by_sequence_order(listed).alias("a"))
    names = F.transform("a", lambda a: a["name"])
    reward = sequence.subsequence_reward(F.array(F.lit("R")), F.transform(F.slice("a", 1, 1), lambda a: F.substring(a["name"], 1, 1)))
    return ordered.select("task_id", F.array_join(names, ">").alias("names"), reward.cast("double").alias("reward"))


# --- faults ----------------------------------------------------------------------------------------------------------------------

DB = (("click", "Missing 1 required argument for {k}", 3), ("click", "Invalid format of '{k}'", 1), ("click", "User not found", 9), ("signup", "number of items should match", 2))
POINTS = "p AS (SELECT event_id, name AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS VARCHAR) AS key FROM evt WHERE kind = 'call')"
MOVED = "CAST(k + ([-100, -50, -10, 10, 50, 100])[m % 6 + 1] AS VARCHAR)"
OWN_MESSAGE = f"(['Invalid k: ''' || {MOVED} || ''' is not a valid format', 'Parameter ''k'' validation failed: expected valid identifier, got ''' || {MOVED} || '''', 'Error processing k: ''' || {MOVED} || ''' does not match expected pattern'])[m % 3 + 1]"


def _database(spark, rows):
    return spark.createDataFrame([("shop", *row) for row in rows], "domain string, tool string, error string, count long")


def _points(spark, d):
    return event_messages(spark, d).where("kind = 'call'").select(F.col("event_id").cast("string").alias("key"), F.lit("shop").alias("domain"), F.col("name").alias("tool"), F.col("props").alias("arguments"))


@query(
    f"""WITH {POINTS}, c AS (SELECT *, {u_sql("key", 3)} AS u, {m_sql("key", 4)} AS m FROM p),
 t AS (SELECT *, CASE WHEN tool = 'click' AND u < 0.25 THEN 'Invalid format of ''{{k}}''' WHEN tool = 'click' THEN 'Missing 1 required argument for {{k}}' WHEN tool = 'signup' THEN 'number of items should match' END AS template FROM c)
 SELECT key, template, CASE WHEN template LIKE 'Missing%' THEN '{{}}' ELSE '{{"k": ' || {MOVED} || '}}' END AS wrong, CASE WHEN template IS NOT NULL THEN replace(template, '{{k}}', CAST(k AS VARCHAR)) ELSE {OWN_MESSAGE} END AS error FROM t""",
    "evt",
)
def rule_error_rows(spark, d):
    """Recoverable errors of the database by count, arguments changed to fit; corrupted arguments where there are none."""
    return faults.rule_errors(_points(spark, d), _database(spark, DB), 3).select("key", "template", "wrong", "error")


@query(f"WITH {POINTS} SELECT key, CASE WHEN tool = 'click' THEN CASE WHEN {u_sql('key', 3)} < 0.25 THEN 'a' ELSE 'b' END END AS template FROM p", "evt")
def template_choice(spark, d):
    """One of a tool's templates in proportion to its count; none for tools without any."""
    db = _database(spark, (("click", "a", 1), ("click", "b", 3), ("other", "c", 1)))
    return faults.choose_templates(_points(spark, d), db, 3, F.lit(True)).select("key", "template")


TYPED_DB = (("click", "Invalid {k}", 1), ("click", "Order is already cancelled", 4))
TEMPLATES = (("business", "shop", "click", "Gift card balance of {k} is not enough"), ("hallucination", "shop", "click", "press"), ("hallucination", "shop", "click", "tap"), ("hallucination", "shop", "signup", "join"))
TYPED = f"""{POINTS}, h AS (SELECT *, {u_sql("key", 8)} AS u, {m_sql("key", 7)} AS m FROM p),
 z AS (SELECT *, CASE WHEN tool = 'click' THEN CASE WHEN u < 0.35 THEN 'parameter' WHEN u < 0.65 THEN 'business' WHEN u < 0.8 THEN 'state' ELSE 'hallucination' END WHEN tool = 'signup' THEN CASE WHEN u * 0.55 < 0.35 THEN 'parameter' ELSE 'hallucination' END ELSE 'parameter' END AS kind FROM h),
 w AS (SELECT *, CASE WHEN kind = 'hallucination' THEN CASE WHEN tool = 'click' THEN (['press', 'tap'])[m % 2 + 1] ELSE 'join' END ELSE tool END AS wrong_tool, CASE WHEN kind IN ('parameter', 'business') THEN '{{"k": ' || {MOVED} || '}}' ELSE '{{"k": ' || k || '}}' END AS wrong FROM z),
 v AS (SELECT *, 'Error: ' || CASE WHEN kind = 'hallucination' THEN 'Tool ''' || wrong_tool || ''' not found.' WHEN kind = 'state' THEN 'Order is already cancelled' WHEN kind = 'business' THEN 'Gift card balance of ' || k || ' is not enough' WHEN tool = 'click' THEN 'Invalid ' || k ELSE {OWN_MESSAGE} END AS error FROM w)"""


def _typed(spark, d):
    templates = spark.createDataFrame(list(TEMPLATES), "kind string, domain string, tool string, text string")
    return faults.typed_errors(_points(spark, d), _database(spark, TYPED_DB), templates, 5)


@query(f"WITH {TYPED} SELECT key, kind, wrong_tool, wrong, error FROM v", "evt")
def typed_error_rows(spark, d):
    """Errors of four kinds by weight among those that a tool can have."""
    return _typed(spark, d).select("key", "kind", "wrong_tool", "wrong", "error")


@query(
    f"""WITH {TYPED} SELECT key, CASE kind WHEN 'parameter' THEN 'The value ''' || {MOVED} || ''' for k was wrong; it should be ''' || k || '''. I will retry with that.' WHEN 'business' THEN 'The request broke a rule (' || left(error, 100) || '). I will work out the right values and retry.'
 WHEN 'state' THEN 'This is not possible in the present state (' || left(error, 100) || '). I will check the state and go on from there.' ELSE 'There is no tool ''' || wrong_tool || '''; the right one is ''' || tool || '''. I will use it.' END
 || chr(10) || '<tool_call>{{"name": "' || tool || '", "arguments": {{"k": ' || k || '}}}}</tool_call>' AS recovery FROM v""",
    "evt",
)
def fault_recoveries(spark, d):
    return faults.recoveries(_typed(spark, d)).select("key", "recovery")


#: A provider's answers, the thought that is kept, and the arguments (null: those of the right call).
ANSWERS = (
    ('<think>hm</think>I see. <tool_call>{"name": "click", "arguments": {"k": 9}}</tool_call>', "I see.", '{"k": 9}'),
    ('```\n<tool_call>{"name": "wrong", "arguments": {}}</tool_call>', "I will correct this and retry.", None),
    ("only words", "only words", None),
    ('<tool_call>{"name": "click", "arguments": [1]}</tool_call>', "I will correct this and retry.", None),
    (" ", None, None),
)


@query(f"SELECT event_id, thought || chr(10) || '<tool_call>{{\"name\": \"click\", \"arguments\": ' || replace(coalesce(args, props), ': ', CASE WHEN args IS NULL THEN ': ' ELSE ':' END) || '}}</tool_call>' AS recovery FROM (SELECT event_id, props, {cases(ANSWERS, 'thought args')} FROM evt WHERE name = 'click')", "evt")
def answered_recoveries(spark, d):
    """A provider's recoveries: the right tool's call is kept, any other gives way to the right call."""
    return event_messages(spark, d).where("name = 'click'").select("event_id", faults.answered_recovery(case(ANSWERS), F.col("name"), F.col("props")).alias("recovery"))


#: Arguments, an error, and the arguments changed to fit.
WRONG = (
    ('{"payment_amount": 100, "x": 1}', '{"payment_amount": 80, "x": 1}', "Payment amount does not add up"),
    ('{"payments": [{"id": "p", "amount": 51}]}', '{"payments": [{"amount": 40, "id": "p"}]}', "payment amount is wrong"),
    ('{"items": [1, 2, 3], "n": [4]}', '{"items": [1, 2], "n": [4]}', "The number of items should match"),
    ('{"amount": 10}', '{"amount": 15}', "Gift card balance is not enough"),
    ('{"a": 7}', "{}", "Missing argument"),
    ('{"order_id": "#W123", "zip": "1"}', '{"order_id": "#W12", "zip": "1"}', "order not found"),
    ('{"note": [1, 2]}', '{"note": [1]}', "anything"),
    ('{"f": 2.5}', '{"f": 1.25}', "anything"),
    ('{"o": {"a": 1}}', '{"o": {}}', "anything"),
    ("{}", None, "anything"),
)


@query(f"SELECT event_id, {cases(WRONG, 'wrong')} FROM events")
def wrong_argument_rules(spark, d):
    """Arguments changed to fit an error message, of every kind."""
    return table(spark, d, "events").select("event_id", faults.render(faults.wrong_arguments(matching.json_map(case(WRONG)), case(WRONG, at=2), F.lit(0))).alias("wrong"))


#: A value, and what each way of corrupting it makes of it.
CORRUPTED = (
    ('"user_id_1"', ('"user_id_"', '"user_id"', '"user-id-1"', '"user"', '"invalid_user_"')),
    ('"ab"', ('"a"', '"a"', '"ab_typo"', '"a"', '"invalid_ab"')),
    ('"x"', ('"x_typo"',)),
    ("[1, 2, 3]", ("[1, 2]",)),
    ("[]", ("[]",)),
    ('{"a": 1}', ("{}",)),
    ("true", ("true",)),
    ("2.5", ("1.25", "2.0", "3.0", "3.75")),
    ("7", ("-93", "-43", "-3", "17", "57", "107")),
)


@query(" UNION ALL ".join(f"SELECT event_id, '{v}' AS original, {sql_choice(ways, f'event_id % {len(ways)}')} AS wrong FROM events WHERE event_id % {len(CORRUPTED)} = {k}" for k, (v, ways) in enumerate(CORRUPTED)))
def value_corruption_kinds(spark, d):
    """Values of every JSON kind in every way."""
    original = case(CORRUPTED)
    return table(spark, d, "events").select("event_id", original.alias("original"), faults.corrupt_value(original, F.col("event_id")).alias("wrong"))


#: Values whose form is kept, and the wrong values of the other corruption.
FORMED = (("#W12", "#W99"), ("ABC123", "ABC999"), ("L1001", "L9999"), ("mia_li_2", "mia_li_9"), ("#W99", "#W990"), ("12", ("22", "2", "62", "-38", "112", "-88")))


@query(f"SELECT event_id, {cases([(v, w if isinstance(w, str) else None) for v, w in FORMED], 'form')} AS formed, ".replace(" AS form AS formed", " AS formed") + f"CASE WHEN event_id % {len(FORMED)} = 5 THEN {sql_choice(FORMED[5][1], 'event_id % 6')} END AS moved, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'z' END AS first FROM events")
def formed_corruption(spark, d):
    """Identifiers that keep their form, numbers that move, and the first argument that differs between two maps."""
    at = F.col("event_id") % len(FORMED)
    wrong = inject.corrupt_text(case(FORMED), F.col("event_id"))
    k = F.col("event_id") % 3
    right, other = F.lit('{"a": 1, "b": 2, "c": 3}'), F.when(k == 0, '{"a": 1, "b": 9, "c": 9}').when(k == 1, '{"z": 1}').otherwise("{}")
    first = matching.first_difference(matching.json_map(right), matching.json_map(other))
    return table(spark, d, "events").select("event_id", F.when(at != 5, wrong).alias("formed"), F.when(at == 5, wrong).alias("moved"), first.alias("first"))


#: Errors and the thoughts that recover from them, every branch.
THOUGHTS = (
    ("the payment amount is off", "The payment amount was wrong; I will recalculate it and retry."),
    ("missing argument", "A required parameter was missing; I will include it and retry."),
    ("number does not match", "The counts did not match; I will check them and retry."),
    ("validation error", "The input was not valid; I will correct its format and retry."),
    ("insufficient funds", "The balance did not suffice; I will check the payment method and retry."),
    ("oops", "The call failed (oops); I will correct the parameters and retry."),
)


@query(f"SELECT event_id, {cases(THOUGHTS, 'thought')} FROM events")
def recovery_thoughts(spark, d):
    return table(spark, d, "events").select("event_id", inject.recovery_thought(case(THOUGHTS)).alias("thought"))


@query(
    f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Polite and patient customer' WHEN c_custkey % 3 = 1 THEN 'none of them' WHEN {u_sql('c_custkey', 2)} < 0.5 THEN (['Careful one', 'Calm one'])[{m_sql('c_custkey', 3)} % 2 + 1] ELSE 'Patient, polite' END AS persona FROM customer"
)
def persona_variation(spark, d):
    persona = F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 3 == 1, "none of them").otherwise("Patient, polite")
    variants = {"frustrated": ("Upset one",), "patient": ("Careful one", "Calm one"), "polite": ("Courteous one",)}
    return table(spark, d, "customer").select("c_custkey", faults.varied_persona(persona, F.col("c_custkey").cast("string"), variants, 2).alias("persona"))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY idx) AS n FROM evt WHERE kind = 'call') SELECT traj_id, n AS number, idx, n % 2 = 0 AS prune FROM p", "evt")
def zipped_decisions(spark, d):
    calls = event_messages(spark, d).where("kind = 'call'")
    number = F.row_number().over(Window.partitionBy("traj_id").orderBy("idx"))
    segments = calls.select("traj_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") * 2).alias("place"))
    decisions = calls.select("traj_id", (number % 2 == 0).alias("prune"), number.alias("place"))
    return faults.numbered_segments(segments, decisions).select("traj_id", F.col("number").cast("long").alias("number"), "idx", "prune")


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY md5(traj_id || ':' || idx || ':7'), idx) AS rk, {u_sql("traj_id || ':' || idx", 8)} AS u FROM evt WHERE kind = 'call')
 SELECT traj_id, string_agg(idx, ',' ORDER BY idx) FILTER (rk <= 2 AND u < 0.3) AS points FROM p GROUP BY traj_id""",
    "evt",
)
def multi_error_points(spark, d):
    """Up to two points of a trajectory at a rate of 0.3 each; null where none is taken."""
    calls = event_messages(spark, d).where("kind = 'call'")
    return faults.chosen_points(calls, 2, 0.3, 7).select("traj_id", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"))


# --- reports -----------------------------------------------------------------------------------------------------------------------

SIM_STATS = """s AS (SELECT traj_id % 4 AS domain, count(*) AS n_steps, count(*) FILTER (name = 'purchase') % 2 AS reward, CASE WHEN count(*) > 55 THEN 'max_steps' WHEN traj_id % 3 = 0 THEN NULL ELSE 'user_stop' END AS reason FROM evt GROUP BY traj_id)"""


def _stat_sims(spark, d):
    grouped = event_messages(spark, d).groupBy("traj_id").agg(F.count("*").alias("n_steps"), (F.count_if(F.col("name") == "purchase") % 2).cast("double").alias("reward"))
    reason = F.when(F.col("n_steps") > 55, "max_steps").when(F.col("traj_id") % 3 != 0, "user_stop")
    return grouped.select((F.col("traj_id") % 4).alias("domain"), "n_steps", "reward", reason.alias("termination_reason"))


@query(
    f"""WITH {SIM_STATS}, g AS (SELECT domain, count(*) AS total_tasks, count(*) FILTER (reward > 0) AS successful_tasks, count(*) FILTER (reward = 0) AS failed_tasks, CAST(sum(n_steps) AS BIGINT) AS total_steps, avg(n_steps) AS avg_steps, count(*) FILTER (reason = 'max_steps') AS max_steps_tasks, count(*) FILTER (reward > 0) * 100 / count(*) AS success_rate FROM s GROUP BY domain)
 SELECT *, row_number() OVER (ORDER BY success_rate, domain) AS place FROM g""",
    "evt",
)
def domain_failure_statistics(spark, d):
    """Per domain, from the worst to the best."""
    from trajlake.operators.numbering import numbered

    ordered = reports.by_success_rate(reports.domain_statistics(_stat_sims(spark, d)))
    return numbered(ordered, ["success_rate", "domain"], "place", first=1)


@query(f"WITH {SIM_STATS} SELECT domain, coalesce(reason, 'unknown') AS termination_reason, count(*) AS n FROM s GROUP BY ALL", "evt")
def termination_by_domain(spark, d):
    return reports.terminations(_stat_sims(spark, d))


@query("SELECT name AS action, count(*) FILTER (NOT called AND discount < 3) AS missing, count(*) FILTER (NOT called AND discount >= 3) AS wrong_parameters, task_id % 3 AS domain FROM ord GROUP BY name, task_id % 3 HAVING count(*) FILTER (NOT called) > 0", "ord")
def failing_actions_by_domain(spark, d):
    """A check that does not say whether the call was found counts as found."""
    found = F.when(F.col("discount") < 3, False).when(F.col("discount") < 6, True)
    checks = order_actions(spark, d).select((F.col("task_id") % 3).alias("domain"), F.col("name").alias("action"), F.col("called").cast("double").alias("score"), found.alias("found"))
    return reports.failing_actions(checks)


@query("SELECT domain, count(*) AS total_tasks, count(*) FILTER (reward > 0) AS successful_tasks, count(*) FILTER (reward = 0) AS failed_tasks, count(*) FILTER (reward > 0) / count(*) AS success_rate, CAST(sum(task_id % 5 + 1) AS BIGINT) AS total_attempts, sum(task_id % 5 + 1) / count(*) AS avg_attempts_per_task FROM lab GROUP BY domain", "lab")
def attempt_statistics(spark, d):
    rows = labelled_runs(spark, d).select("domain", (F.col("reward") > 0).alias("success"), (F.col("task_id") % 5 + 1).alias("num_attempts"))
    return reports.attempt_statistics(rows, "domain")


HISTORY = "h AS (SELECT source AS task_id, task_id AS seq, reward > 0 AS success, CASE task_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'get,buy' END AS tools FROM lab)"


def _attempts(spark, d):
    tools = F.when(F.col("task_id") % 3 == 0, F.array(F.lit("get"))).when(F.col("task_id") % 3 == 1, F.array(F.lit("get"), F.lit("buy")))
    return labelled_runs(spark, d).select(F.col("source").alias("task_id"), F.col("task_id").alias("seq"), (F.col("reward") > 0).alias("success"), tools.alias("fail_tools"))


@query(f"WITH {HISTORY} SELECT task_id, count(*) AS attempts, count(*) FILTER (NOT success) AS failures, count(*) FILTER (NOT success) / count(*) AS fail_rate, coalesce(string_agg(tools, ',' ORDER BY seq) FILTER (NOT success AND tools IS NOT NULL), '') AS fail_tools FROM h GROUP BY task_id", "lab")
def failure_history_tools(spark, d):
    out = reports.failure_history(_attempts(spark, d))
    return out.withColumn("fail_tools", F.array_join("fail_tools", ","))


@query(f"WITH {HISTORY} SELECT 'get' AS tool, count(*) AS n FROM h WHERE NOT success AND tools IS NOT NULL UNION ALL SELECT 'buy', count(*) FROM h WHERE NOT success AND tools LIKE '%buy'", "lab")
def tool_failure_histogram(spark, d):
    return reports.tool_failures(_attempts(spark, d))


@query("SELECT count(*) FILTER (reward > 0 AND NOT is_error) AS success_count, count(*) FILTER (NOT (reward > 0 AND NOT is_error)) AS fail_count, count(*) FILTER (is_error) AS exception_count FROM lab", "lab")
def outcome_counts(spark, d):
    rows = labelled_runs(spark, d).select(F.when(F.col("task_id") % 2 == 0, F.col("reward") > 0).otherwise(F.when(F.col("reward") > 0, True)).alias("success"), F.when(F.col("is_error"), "boom").alias("exception"))
    return reports.outcome_counts(rows)


COUNTERS = """r AS (SELECT doc_id, n_chars % 7 AS h, n_chars % 3 AS t, n_chars % 5 AS pr, least(n_chars % 7, doc_id % 4) AS ok, doc_id % 4 AS c, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 4 END AS n_it, n_chars % 6 AS seg, least(n_chars % 6, doc_id % 3) AS cut FROM documents)"""


def _records(spark, d):
    """Documents as synthetic records: counters from their numbers, some missing."""
    n, k = F.col("n_chars"), F.col("doc_id")
    it = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda x: x))
    return table(spark, d, "documents").select(
        "doc_id", (n % 7).alias("total_hallucination_count"), (n % 3).alias("hallucinated_tool_count"), F.when(n % 5 > 0, n % 5).alias("hallucinated_param_count"), F.least(n % 7, k % 4).alias("resolved_count"), F.lit(None).cast("long").alias("failed_count"),
        (k % 4).alias("total_corrections"), it.alias("iterations_used"), (n % 6).alias("total_segments_detected"), F.least(n % 6, k % 3).alias("segments_pruned"), F.lit(0).cast("long").alias("segments_kept"),
    )


@query(
    f"""WITH {COUNTERS}, s AS (SELECT count(*) AS n, sum(h) AS h, sum(t) AS t, sum(pr) AS pr, sum(ok) AS ok, sum(c) AS c, sum(n_it) AS n_it, sum(n_it * (n_it + 1) // 2) AS s_it, sum(seg) AS seg, sum(cut) AS cut FROM r)
 SELECT n AS successful_tasks, CAST(h AS BIGINT) AS total_hallucination_count, CAST(t AS BIGINT) AS hallucinated_tool_count, CAST(pr AS BIGINT) AS hallucinated_param_count, CAST(ok AS BIGINT) AS resolved_count, 0::BIGINT AS failed_count, CAST(c AS BIGINT) AS total_corrections, CAST(seg AS BIGINT) AS total_segments_detected, CAST(cut AS BIGINT) AS segments_pruned, 0::BIGINT AS segments_kept,
 CAST(n + 7 AS BIGINT) AS total_tasks, n * 100 / (n + 7) AS success_rate, h / n AS avg_hallucinations_per_task, ok * 100 / h AS hallucination_success_rate, c / n AS avg_user_corrections_per_task, s_it / n_it AS avg_correction_iterations, cut * 100 / seg AS pruning_rate FROM s"""
)
def synthetic_totals(spark, d):
    records = _records(spark, d)
    return reports.synthetic_totals(records, records.count() + 7)


@query(f"WITH {COUNTERS} SELECT doc_id, CASE WHEN h = 0 THEN 0.0 ELSE ok * 100 / h END AS hallucination_success_rate, CASE WHEN n_it = 0 THEN 0.0 ELSE (n_it + 1) / 2 END AS avg_correction_iterations, CASE WHEN seg = 0 THEN 0.0 ELSE cut * 100 / seg END AS pruning_rate FROM r")
def record_summaries(spark, d):
    return reports.record_summary(_records(spark, d)).select("doc_id", "hallucination_success_rate", "avg_correction_iterations", "pruning_rate")


@query(
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS c, o_orderstatus AS s, o_orderkey % 4 AS n FROM orders)
 SELECT 'complexity' AS measure, c AS value, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c UNION ALL SELECT 'task_type', s, count(*) FROM t GROUP BY s UNION ALL SELECT 'n_actions', CAST(n AS VARCHAR), count(*) FROM t GROUP BY n"""
)
def notes_statistics(spark, d):
    k = F.col("o_orderkey")
    notes = F.concat(F.when(k % 3 == 0, "made | ").otherwise(F.concat(F.lit("made | Complexity: "), "o_orderpriority", F.lit(" | "))), F.lit("Type: "), "o_orderstatus")
    return reports.notes_statistics(table(spark, d, "orders").select(notes.alias("notes"), (k % 4).alias("n_actions")))


@query(
    """WITH g AS (SELECT role AS component, CAST(sum(length(content)) AS BIGINT) AS input_tokens, CAST(sum(idx) AS BIGINT) AS output_tokens, count(*) AS calls FROM conv GROUP BY role), c AS (SELECT *, input_tokens / 1000000 * 3.0 + output_tokens / 1000000 * 15.0 AS cost FROM g)
 SELECT component, input_tokens, output_tokens, calls, round(cost, 9) AS cost, round(cost * 100 / sum(cost) OVER (), 6) AS percentage FROM c""",
    "conv",
)
def cost_by_component(spark, d):
    usage = conversation_messages(spark, d).select(F.col("role").alias("component"), F.length("content").alias("input_tokens"), F.col("idx").alias("output_tokens"))
    out = reports.cost_report(usage, 3.0, 15.0)
    return out.select("component", "input_tokens", "output_tokens", "calls", F.round("cost", 9).alias("cost"), F.round("percentage", 6).alias("percentage"))


@query(
    """WITH c AS (SELECT task_id, count(*) AS n, count(*) FILTER (called) AS met FROM ord GROUP BY task_id), r AS (SELECT task_id, met / n AS conditions, CASE WHEN task_id % 3 = 0 THEN 1.0 ELSE (task_id % 2 = 0)::INT / 1 END AS communicate FROM c)
 SELECT task_id, conditions, communicate, CASE task_id % 4 WHEN 0 THEN (conditions + communicate) / 2 WHEN 1 THEN conditions WHEN 2 THEN 0.25 ELSE 1.0 END AS reward, CASE task_id % 4 WHEN 0 THEN (conditions + communicate) / 2 WHEN 1 THEN conditions WHEN 2 THEN 0.25 ELSE 1.0 END >= 0.7 AS success FROM r""",
    "ord",
)
def condition_rewards(spark, d):
    """Shares of conditions and of information conveyed, and the final reward: their mean, else the action's, else 1."""
    t = order_actions(spark, d).groupBy("task_id").agg(F.collect_list(F.when(F.col("called"), True)).alias("c"), F.count("*").alias("n"))
    k = F.col("task_id")
    flags = F.concat(F.col("c"), F.array_repeat(F.lit(None).cast("boolean"), (F.col("n") - F.size("c")).cast("int")))
    told = F.when(k % 3 == 0, F.array().cast("array<boolean>")).otherwise(F.array(k % 2 == 0))
    rows = t.select("task_id", reports.share_satisfied(flags).alias("conditions"), reports.share_satisfied(told).alias("communicate"))
    kind = k % 4
    reward = scoring.final_reward(F.when(kind == 2, 0.25), F.when(kind == 0, F.col("communicate")), F.when(kind < 2, F.col("conditions")))
    return rows.withColumn("reward", reward).withColumn("success", F.col("reward") >= 0.7)


@query(
    """WITH r AS (SELECT user_id AS source, event_id, event_type IN ('error', 'click') AS bad, sum((event_type NOT IN ('error', 'click'))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
 SELECT source, min(event_id) AS run_start, count(*) AS run_length, count(*) >= 3 AS trips FROM r WHERE bad GROUP BY source, g"""
)
def connection_error_runs(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("source"), "event_id", F.when(F.col("event_type") == "error", "Socket closed").when(F.col("event_type") == "click", "status 502").otherwise("fine").alias("message"))
    return reports.connection_failures(rows, "source", "event_id", "message", 3)


@query(
    """WITH g AS (SELECT lang AS domain, source AS tool, 'e' || doc_id % 9 AS error, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain, tool ORDER BY n DESC, error) AS k FROM g)
 SELECT domain, tool, string_agg(error || ' (occurred ' || n || ' times)', '|' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY domain, tool"""
)
def top_error_examples(spark, d):
    db = table(spark, d, "documents").groupBy(F.col("lang").alias("domain"), F.col("source").alias("tool"), F.concat(F.lit("e"), (F.col("doc_id") % 9).cast("string")).alias("error")).agg(F.count("*").alias("count"))
    return reports.top_examples(db, 3).withColumn("examples", F.array_join("examples", "|"))


# --- samples and tasks ------------------------------------------------------------------------------------------------------------

@query("SELECT c.c_custkey, CASE WHEN o.last_order IS NOT NULL THEN 'order ' || o.last_order WHEN c.c_custkey % 2 = 0 THEN 'order ' || g.o ELSE 'product ' || p.p END AS pick FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey, (SELECT min(o_orderkey) AS o FROM orders) g, (SELECT min(p_partkey) AS p FROM part) p")
def own_order_any_or_product(spark, d):
    """A customer's own order, else any order, else a product: even customers fall back to orders, odd ones find none."""
    orders = table(spark, d, "orders")
    own = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    one = orders.agg(F.min("o_orderkey").alias("o")).crossJoin(table(spark, d, "part").agg(F.min("p_partkey").alias("p")))  # one row each
    rows = table(spark, d, "customer").select("c_custkey").join(own, "c_custkey", "left").crossJoin(F.broadcast(one))
    any_order = F.when(F.col("c_custkey") % 2 == 0, F.col("o"))
    return rows.select("c_custkey", F.coalesce(F.concat(F.lit("order "), F.col("last_order").cast("string")), F.concat(F.lit("order "), any_order.cast("string")), F.concat(F.lit("product "), F.col("p").cast("string"))).alias("pick"))


@query("SELECT row_number() OVER (ORDER BY md5(n_nationkey || ':4'), n_nationkey) - 1 AS draw, n_nationkey FROM nation QUALIFY draw < 7")
def weighted_sample_without_weights(spark, d):
    """All weights are 0: a uniform sample, each row once."""
    rows = table(spark, d, "nation").select("n_nationkey", F.lit(0).alias("w"))
    return sampling.sample_with_replacement(rows, 7, "w", "n_nationkey", 4).select("draw", "n_nationkey")


@query(
    f"""WITH p AS (SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'odd' END AS c FROM nation), u AS (SELECT i AS draw, {u_sql("i", 3)} AS a, {u_sql("i", 4)} AS b FROM range(300) t(i)),
 w AS (SELECT draw, b, CASE WHEN a < 0.3 THEN 'simple' WHEN a < 0.8 THEN 'medium' ELSE 'complex' END AS wanted FROM u), o AS (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY k) AS n, count(*) OVER (PARTITION BY c) AS total FROM (SELECT c, k FROM p UNION ALL SELECT '*', k FROM p))
 SELECT w.draw, w.wanted, o.k AS pattern FROM w JOIN o ON o.c = CASE WHEN w.wanted = 'complex' THEN '*' ELSE w.wanted END AND w.b >= (o.n - 1) / o.total AND w.b < o.n / o.total"""
)
def sampled_configs(spark, d):
    """Patterns by weighted complexity; of all patterns where no pattern is complex."""
    kind = F.when(F.col("n_regionkey") == 0, "simple").when(F.col("n_regionkey") == 1, "medium").otherwise("odd")
    patterns = table(spark, d, "nation").select(F.col("n_nationkey").alias("pattern"), kind.alias("complexity"))
    return sampling.sampled_configs(patterns, {"simple": 0.3, "medium": 0.5, "complex": 0.2}, 300, "complexity", "pattern", 3).select("draw", "wanted", "pattern")


@query("WITH r AS (SELECT task_id, domain, row_number() OVER (PARTITION BY domain ORDER BY task_id) AS n FROM lab) SELECT task_id, domain, row_number() OVER (ORDER BY n, domain) - 1 AS place FROM r", "lab")
def turn_order(spark, d):
    return sampling.turn_order(labelled_runs(spark, d).select("task_id", "domain"), "domain", "task_id")


@query(
    "SELECT dataset, part, count(*) AS n FROM (SELECT task_id, CASE task_id % 5 WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' WHEN 2 THEN 'no_contrast' WHEN 3 THEN 'only_correct' ELSE 'correct_error_mix' END AS part FROM lab) JOIN (VALUES ('real', 'main'), ('synthetic', 'main'), ('no_contrast', 'no_contrast'), ('only_correct', 'correct_only'), ('correct_error_mix', 'mixed_correct_error')) v(part, dataset) USING (part) GROUP BY ALL",
    "lab",
)
def experiment_variants(spark, d):
    rows = labelled_runs(spark, d).select("task_id")
    parts = {name: rows.where(F.col("task_id") % 5 == k) for k, name in enumerate(("real", "synthetic", "no_contrast", "only_correct", "correct_error_mix"))}
    return sampling.experiment_mix(parts).groupBy("dataset", "part").agg(F.count("*").alias("n"))


@query()
def category_sample(spark, d):
    """One to three brands, 5 to 10 parts of one of them and 2 to 5 of the others."""
    return sampling.category_sample(table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("api")), 5)


_CUT = "sum(w) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)"


@query(
    f"""WITH u AS (SELECT i AS config, {", ".join(f"{u_sql('i', 9 + k)} AS u{k}" for k in range(9))} FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i)),
 seg AS (SELECT k, {_CUT} / sum(w) OVER () AS high, ({_CUT} - w) / sum(w) OVER () AS low FROM (SELECT c_mktsegment AS k, count(*) AS w FROM customer GROUP BY 1)),
 leg AS (SELECT n_nationkey, n_name AS origin, lead(n_name, 1, first_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS destination FROM (SELECT *, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first_name FROM nation)),
 rt AS (SELECT origin, destination, {_CUT} / sum(w) OVER () AS high, ({_CUT} - w) / sum(w) OVER () AS low FROM (SELECT origin, destination, origin || '>' || destination AS k, count(*) AS w FROM leg JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)),
 p AS (SELECT u.*, seg.k AS persona, origin, destination FROM u JOIN seg ON u0 >= seg.low AND u0 < seg.high JOIN rt ON u1 >= rt.low AND u1 < rt.high)
 SELECT config, persona, CASE WHEN u4 < 0.3 THEN 'simple' WHEN u4 < 0.8 THEN 'medium' ELSE 'complex' END AS complexity,
 strftime(DATE '2024-05-15' + CAST(CASE WHEN u2 < 0.2 THEN 1 + floor(u3 * 7) WHEN u2 < 0.7 THEN 14 + floor(u3 * 32) ELSE 90 + floor(u3 * 91) END AS INTEGER), '%Y-%m-%d') AS date, origin, destination,
 CASE WHEN persona = 'MACHINERY' THEN 'basic_economy' WHEN u5 < 0.3 THEN 'basic_economy' WHEN u5 < 0.8 THEN 'economy' ELSE 'business' END AS cabin,
 CASE WHEN persona = 'HOUSEHOLD' THEN 3 + CAST(floor(u8 * 3) AS INTEGER) WHEN u7 < 0.6 THEN 1 WHEN u7 < 0.8 THEN 2 WHEN u7 < 0.9 THEN 3 WHEN u7 < 0.97 THEN 4 ELSE 5 END AS passengers FROM p"""
)
def diverse_configs(spark, d):
    """A task for each customer: personas by the market segments' sizes, routes within regions by the origins' suppliers."""
    segment = F.col("c_mktsegment")
    customers = table(spark, d, "customer")
    personas = customers.groupBy(segment.alias("persona")).agg(F.count("*").cast("double").alias("weight"))
    bound = lambda name, values: F.when(F.col("persona") == name, F.array(*map(F.lit, values)))
    personas = personas.select("*", bound("MACHINERY", ["basic_economy"]).alias("cabins"), bound("HOUSEHOLD", ["3", "4", "5"]).alias("party"))
    near = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    onward = F.coalesce(F.lead("n_name").over(near), F.first("n_name").over(near))
    legs = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("origin"), onward.alias("destination"))
    routes = table(spark, d, "supplier").join(legs, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("origin", "destination").agg(F.count("*").cast("double").alias("weight"))
    return generate.diverse_configs(spark, customers.count(), routes, personas, "2024-05-15", 9)


@query(
    f"""WITH s AS (SELECT 'p_brand' AS param, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size),
 w AS (SELECT *, sum(n) OVER (PARTITION BY param ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY param) AS high, (sum(n) OVER (PARTITION BY param ORDER BY value ROWS UNBOUNDED PRECEDING) - n) / sum(n) OVER (PARTITION BY param) AS low FROM s),
 t AS (SELECT i AS draw, (CAST('0x' || substring(md5(i || ':6'), 1, 8) AS BIGINT)) % 2 AS template_id, {u_sql("i || ':p_brand'", 5)} AS ub, {u_sql("i || ':p_size'", 5)} AS us FROM range(200) r(i))
 SELECT t.draw, t.template_id, CASE t.template_id WHEN 0 THEN 'Find ' || b.value || ' in size ' || z.value || '.' ELSE 'Exchange the {{p_type}} by ' || b.value || '.' END AS text
 FROM t JOIN w b ON b.param = 'p_brand' AND t.ub >= b.low AND t.ub < b.high JOIN w z ON z.param = 'p_size' AND t.us >= z.low AND t.us < z.high"""
)
def task_instantiation(spark, d):
    """A template for each draw, filled with brands and sizes by their frequency; a placeholder without a value stays."""
    space = generate.parameter_space(table(spark, d, "part"), ["p_brand", "p_size"])
    templates = spark.createDataFrame([(0, "Find {p_brand} in size {p_size}."), (1, "Exchange the {p_type} by {p_brand}.")], "template_id long, text string")
    return generate.instantiate(templates, generate.parameter_draws(space, 200, 5), 6)


@query("SELECT p_partkey, p_partkey % 3 = 0 AS placeholder, CAST(p_partkey AS VARCHAR) || '_0' AS action_id, p_partkey % 4 AS endpoint, strftime(DATE '2024-02-27' + CAST(p_size AS INTEGER), '%Y-%m-%d') AS due FROM part")
def assembled_tasks(spark, d):
    """The file form of tasks, placeholders left in their arguments, endpoints in turn, dates from a base."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    action = F.struct(F.col("p_brand").alias("name"), F.lit("{}").alias("arguments"))
    rows = table(spark, d, "part").select(
        "p_partkey", "p_size", k.cast("string").alias("id"), F.array(action).alias("actions"), *[none.alias(c) for c in ("persona", "domain", "reason_for_call", "known_info", "unknown_info", "task_instructions", "purpose", "notes")], *[F.array().cast("array<string>").alias(c) for c in ("communicate_info", "nl_assertions", "reward_basis")]
    )
    arguments = F.create_map(F.lit("a"), F.when(k % 3 == 0, "<ID>").otherwise("x"))
    made = generate.assembled_task(rows).select(F.col("id").alias("_id"), F.col("evaluation_criteria.actions")[0]["action_id"].alias("action_id"))
    joined = rows.join(made, rows["id"] == made["_id"])
    return joined.select("p_partkey", generate.placeholders_left(arguments).alias("placeholder"), "action_id", sampling.endpoint(k, 4).alias("endpoint"), generate.dated(F.to_date(F.lit("2024-02-27")), F.col("p_size")).alias("due"))


class _Judge:
    """Scores a prompt by its length; every seventh answer is no JSON."""

    def open(self) -> None:
        pass

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [None if not p else "no" if len(p) % 7 == 0 else f'```json\n{{"clear": {len(p) % 5 + 1}, "right": 9}}\n```' for p in prompts]


@query("SELECT c_custkey, CASE WHEN length(c_name) % 7 = 0 OR c_name = '' THEN NULL ELSE length(c_name) % 5 + 1 END AS clear, length(c_name) % 7 <> 0 AND length(c_name) % 5 + 1 >= 3 AS passes FROM (SELECT c_custkey, left(c_name, CAST(c_custkey % 18 + 1 AS INTEGER)) AS c_name FROM customer)")
def provider_judgements(spark, d):
    """Judged by a provider: scores held to 1 to 5, a gate over all of them, unusable answers do not pass."""
    rows = table(spark, d, "customer").select("c_custkey", F.substr("c_name", F.lit(1), (F.col("c_custkey") % 18 + 1).cast("int")).alias("prompt"))
    out = provider.judged(rows, "prompt", ("clear", "right"), 3, _Judge(), retries=2)
    return out.select("c_custkey", F.when(F.col("scores")["clear"].isNotNull(), F.col("scores")["clear"]).cast("long").alias("clear"), "passes")
