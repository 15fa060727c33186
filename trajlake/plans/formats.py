"""Registered queries over native messages and training formats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajlake.functions import matching
from trajlake.operators import metrics, native, training
from trajlake.plans.adapters import conversation_messages, event_messages, native_messages, order_actions, table
from trajlake.plans.registry import choice, query, sql_choice

NATIVE = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,raw_data:struct<reasoning_content:string,thinking:string>>"


# --- native messages ------------------------------------------------------------------------------------------------------


def _native_lists(spark, d):
    raw = F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("reasoning_content"), F.lit(None).cast("string").alias("thinking"))
    parts = F.struct("idx", F.struct("role", "content", "tool_call_id", "tool_calls", raw.alias("raw_data")).cast(NATIVE).alias("m"))
    return native_messages(spark, d).groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(parts), lambda a, b: a["idx"] - b["idx"]), lambda x: x["m"]).alias("messages"))


@query("SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY idx) - 1 AS number, idx AS turn, 'c' || event_id AS id, name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM nat WHERE kind = 'call'", "nat")
def native_call_flatten(spark, d):
    calls = _native_lists(spark, d).select("traj_id", F.explode(native.structured_calls(F.col("messages"))).alias("c"))
    return calls.select("traj_id", F.col("c.number").cast("long").alias("number"), F.col("c.turn").cast("long").alias("turn"), "c.id", "c.name", F.get_json_object("c.arguments", "$.k").cast("long").alias("k"))


@query("SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY idx) - 1 AS number, idx AS turn, call_name AS tool, left(err, 10) AS content, true AS is_error FROM nat WHERE kind = 'result'", "nat")
def native_named_results(spark, d):
    found = _native_lists(spark, d).select("traj_id", F.explode(native.named_results(F.col("messages"), 10)).alias("r"))
    return found.select("traj_id", F.col("r.number").cast("long").alias("number"), F.col("r.turn").cast("long").alias("turn"), "r.tool", "r.content", "r.is_error")


@query("SELECT traj_id, idx AS turn, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS reasoning, 1 AS n_calls FROM nat WHERE kind = 'call'", "nat")
def native_agent_responses(spark, d):
    found = _native_lists(spark, d).select("traj_id", F.explode(native.agent_responses(F.col("messages"))).alias("r"))
    return found.select("traj_id", F.col("r.turn").cast("long").alias("turn"), F.col("r.reasoning_content").alias("reasoning"), F.size("r.tool_calls").alias("n_calls"))


#: Expected actions with values of every kind; a call's list and text are made from its number and user.
EXPECTED = (("click", '{"k": 1, "tags": [1, "A"], "who": "USER", "o": {"x": true}}', None), ("purchase", '{"k": 77.0004}', "agent"), ("signup", '{"k": 5, "who": "nobody"}', "user"), ("refund", "{}", None))


def _native_runs(spark, d):
    """(simulations, tasks) as the readers give them: every user one simulation, one task for all, found by id or position."""
    rich = F.concat(F.lit('{"k": '), F.get_json_object("c.arguments", "$.k"), F.lit(', "tags": ["a", '), F.get_json_object("c.arguments", "$.k"), F.lit('], "who": " user "'), F.lit(', "o": {"x": true}}'))
    rows = native_messages(spark, d).withColumn("c", F.get("tool_calls", F.lit(0)))
    rows = rows.withColumn("tool_calls", F.when(F.col("role") == "assistant", F.array(F.struct("c.id", "c.name", rich.alias("arguments")))))
    parts = F.struct("idx", F.struct("role", "content", "tool_call_id", "tool_calls", F.lit(None).alias("raw_data")).cast(NATIVE).alias("m"))
    sims = rows.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(parts), lambda a, b: a["idx"] - b["idx"]), lambda x: x["m"]).alias("messages"), F.count_if(F.col("c.name") == "purchase").alias("n"))
    inner = F.struct((F.col("n") % 2).cast("double").alias("reward"))
    sims = sims.select("traj_id", F.when(F.col("traj_id") % 2 == 0, "t").otherwise("0").alias("task_id"), F.lit(0.0).alias("reward"), inner.alias("reward_info"), "messages")
    sims = sims.withColumn("reward", metrics.effective_reward(F.col("reward"), F.col("reward_info.reward")))
    kind = "array<struct<name:string,arguments:string,requestor:string>>"
    actions = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("arguments"), F.lit(r).cast("string").alias("requestor")) for n, a, r in EXPECTED]).cast(kind)
    task = F.struct(F.lit("t").alias("id"), F.struct(actions.alias("actions")).alias("evaluation_criteria"), F.lit(20).alias("expected_turns"))
    return sims, spark.range(1).select(F.explode(F.array(F.lit("t"), F.lit("0"))).alias("key"), task.alias("task"))


NATIVE_SIMS = """s AS (SELECT traj_id, count(*) FILTER (role IN ('user', 'assistant')) AS n_messages, CAST(count(*) FILTER (name = 'purchase') % 2 AS DOUBLE) AS reward, count(*) FILTER (kind = 'result') AS n_errors,
  coalesce(max(CASE WHEN name = 'click' THEN CASE WHEN k = 1 THEN 1.0 ELSE 0.5 END END), -1) AS c1, coalesce(max(CASE WHEN name = 'purchase' THEN CASE WHEN k = 77 THEN 1.0 ELSE 0.0 END END), -1) AS c2
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM nat) GROUP BY traj_id),
 m AS (SELECT traj_id, reward > 0 AS success, n_errors, CASE WHEN reward > 0 THEN greatest(n_errors - 1, 0) ELSE 0 END AS n_recovered,
  ((c1 >= 0)::INT + (c2 >= 0)::INT) / 3 AS tool_call_accuracy, (greatest(c1, 0) + greatest(c2, 0)) / 3 AS parameter_accuracy,
  CASE WHEN n_messages = 0 THEN 0.0 ELSE least(CAST(20 AS DOUBLE) / n_messages, 1.0) END AS conversation_efficiency, CASE WHEN n_errors = 0 THEN 1.0 WHEN reward > 0 THEN greatest(n_errors - 1, 0) / n_errors ELSE 0.0 END AS error_recovery_rate FROM s)"""


@query(f"WITH {NATIVE_SIMS} SELECT * FROM m", "nat")
def native_simulation_metrics(spark, d):
    """Native messages and tasks to A1: calls, results and expected actions from nested structures, arguments of any depth."""
    sims, tasks = _native_runs(spark, d)
    out = native.native_metrics(native.native_simulations(sims, tasks))
    return out.select("traj_id", "success", "n_errors", "n_recovered", *metrics.METRICS)


@query(
    f"""WITH {NATIVE_SIMS} SELECT count(*) AS n, count(*) FILTER (success) AS n_success, round(avg(tool_call_accuracy) * 100, 6) AS tool_call_accuracy, round(avg(parameter_accuracy) * 100, 6) AS parameter_accuracy,
 round(avg(conversation_efficiency) * 100, 6) AS conversation_efficiency, round(avg(error_recovery_rate) * 100, 6) AS error_recovery_rate FROM m""",
    "nat",
)
def native_extended_metrics(spark, d):
    sims, tasks = _native_runs(spark, d)
    out = metrics.overall_metrics(native.native_metrics(native.native_simulations(sims, tasks)))
    return out.select("n", "n_success", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


JSON_PAIRS = (
    ('{"a": "X y", "b": 1}', '{"a": " x Y ", "b": 1.0005}', 1.0), ('{"a": [1, "B"]}', '{"a": ["b", 1]}', 1.0), ('{"a": [1, 2]}', '{"a": [1]}', 0.0), ('{"a": {"c": 1}, "b": true}', '{"a": {"c": 1}, "b": "TRUE"}', 1.0),
    ('{"a": "12"}', '{"a": "123"}', 1.0), ('{"a": 12}', '{"a": 123}', 0.0), ('{"a": "5"}', '{"a": 5}', 1.0), ('{"a": null, "b": 1}', '{"a": null}', 0.5), ('{"a": 1}', "no object", 0.0), ("{}", "{}", 1.0), ('{"a": ""}', '{"a": "any"}', 1.0), ('{"a": 1}', '{"a": 1}{"b": 2}', 0.0),
)


@query(f"SELECT event_id, {sql_choice([s for _, _, s in JSON_PAIRS], f'event_id % {len(JSON_PAIRS)}')}::DOUBLE AS score FROM evt", "evt")
def json_argument_scores(spark, d):
    """Values of every kind, nested and odd ones, against the scores that the matching rules give."""
    at = F.col("event_id") % len(JSON_PAIRS)
    return event_messages(spark, d).select("event_id", matching.json_parameter_score(choice([a for a, _, _ in JSON_PAIRS], at), choice([b for _, b, _ in JSON_PAIRS], at)).alias("score"))


@query("SELECT event_id, name = 'click' AND k = 1 AS compared, name = 'click' AS name_only, false AS lacking FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM evt WHERE kind = 'call')", "evt")
def compare_args_match(spark, d):
    rows = event_messages(spark, d).where("kind = 'call'")
    expected = lambda compare: F.struct(F.lit("click").alias("name"), F.lit('{"k": 1}').alias("arguments"), compare.alias("compare_args"))
    calls = F.array(F.struct("name", F.col("props").alias("arguments")))
    three = native.matching_calls(F.array(expected(F.array(F.lit("k"))), expected(F.lit(None).cast("array<string>")), expected(F.array(F.lit("k"), F.lit("z")))), calls)
    return rows.select("event_id", three[0].alias("compared"), three[1].alias("name_only"), three[2].alias("lacking"))


# --- training formats -----------------------------------------------------------------------------------------------------------

CALL_TEXT = "chr(10) || '<tool_call>' || chr(10) || '{\"name\": \"' || name || '\", \"arguments\": ' || props || '}' || chr(10) || '</tool_call>'"


def _training_sql(name: str, source: str) -> str:
    return f"""{name}_s AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN ucall END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS skip FROM {source}),
 {name}_k AS (SELECT *, coalesce(sum((role <> 'tool')::INT) OVER (PARTITION BY traj_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM {name}_s WHERE NOT (role = 'user' AND ucall) AND NOT (role = 'tool' AND skip)),
 {name}_t AS (SELECT traj_id, later, role, min(idx) AS idx, count(*) AS parts, string_agg(CASE WHEN role = 'tool' THEN '{{"name": "' || call_name || '", "result": "' || err || '"}}' WHEN role = 'assistant' THEN {CALL_TEXT} ELSE content END, '' ORDER BY idx) AS content
  FROM {name}_k WHERE role <> 'tool' OR later > 0 GROUP BY traj_id, later, role),
 {name}_e AS (SELECT *, lag(role) OVER w AS b, lead(role) OVER w AS f FROM {name}_t WINDOW w AS (PARTITION BY traj_id ORDER BY idx)),
 {name} AS (SELECT traj_id, idx, role, content, parts FROM {name}_e WHERE NOT (b IS NULL AND role = 'assistant') AND NOT (f IS NULL AND role = 'user'))"""


@query(f"WITH {_training_sql('tr', 'nat')} SELECT traj_id, idx, role, content FROM tr", "nat")
def training_rows_native(spark, d):
    """Calls rendered, results named and merged, the user side's calls and their results left out, ends trimmed."""
    return training.training_rows(native_messages(spark, d)).select("traj_id", F.col("idx").cast("long").alias("idx"), "role", "content")


@query(
    """WITH s AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN ucall END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS skip FROM nat)
 SELECT traj_id, idx, role FROM s WHERE NOT skip""",
    "nat",
)
def user_call_spans(spark, d):
    rows = native_messages(spark, d).withColumn("content", F.when((F.col("role") == "user") & F.col("tool_calls").isNotNull(), F.lit('<tool_call>{"name": "self", "arguments": {}}</tool_call>')).otherwise(F.col("content")))
    return training.drop_user_calls(rows).select("traj_id", F.col("idx").cast("long").alias("idx"), "role")


@query(
    """WITH s AS (SELECT *, CASE WHEN kind = 'result' AND traj_id % 2 = 1 THEN 2 ELSE 1 END AS copies, max(CASE WHEN kind = 'call' THEN idx END) OVER (PARTITION BY traj_id) AS last FROM nat),
 h AS (SELECT traj_id, idx, last, CASE WHEN kind = 'call' THEN 'said' || chr(10) || '<tool_call>{"name": "' || name || '", "arguments": ' || props || '}</tool_call>'
  WHEN kind = 'text' THEN content WHEN copies = 1 THEN r ELSE r || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || r END AS content FROM (SELECT *, '{"name": "' || call_name || '", "result": "' || err || '"}' AS r FROM s)),
 k AS (SELECT * FROM h WHERE traj_id % 3 <> 0 OR idx <= last)
 SELECT traj_id, count(*) AS n, md5(string_agg(content, chr(10) ORDER BY idx)) AS digest FROM k WHERE traj_id % 5 <> 0 GROUP BY traj_id""",
    "nat",
)
def decoded_history_rows(spark, d):
    """Histories of every third user end at the last call, those of every fifth hold a user's call and are refused, and every
    other user's results come in pairs."""
    rows = native_messages(spark, d).withColumn("_names", F.lit(None).cast("string"))
    so_far = Window.partitionBy("traj_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(F.when(F.col("role") == "assistant", F.get("tool_calls", F.lit(0))["name"]), ignorenulls=True).over(so_far), F.lit("unknown"))
    one = F.struct(last.alias("name"), F.col("content"))
    responses = F.when(F.col("role") == "tool", F.when(F.col("traj_id") % 2 == 1, F.array(one, one)).otherwise(F.array(one)))
    said = F.when(F.col("role") == "assistant", F.lit("said")).when(F.col("role") == "user", F.col("content"))
    calls = F.when((F.col("role") == "assistant") | ((F.col("traj_id") % 5 == 0) & (F.col("role") == "user")), F.coalesce("tool_calls", F.array(F.struct(F.lit("x").alias("id"), F.lit("x").alias("name"), F.lit("{}").alias("arguments")))))
    parts = rows.select("traj_id", "idx", "role", said.alias("content"), calls.alias("tool_calls"), responses.alias("responses"))
    lists = parts.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct("role", "content", "tool_calls", "responses").alias("m"))), lambda a, b: a["idx"] - b["idx"]), lambda x: x["m"]).alias("h"))
    out = lists.select("traj_id", training.decoded_history(F.col("h"), F.col("traj_id") % 3 == 0).alias("m")).where("m is not null")
    return out.select("traj_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda m: m["content"]), "\n")).alias("digest"))


@query(
    f"""WITH nat2 AS (SELECT * FROM nat WHERE NOT (kind = 'call' AND event_id % 13 = 0)), {_training_sql('tr', 'nat2')},
 n AS (SELECT *, role = 'tool' AND parts = 1 AS bad, lead(role) OVER (PARTITION BY traj_id ORDER BY idx) AS nx FROM tr),
 i AS (SELECT traj_id, count(*) AS run FROM (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM n WHERE role = 'tool') WHERE bad GROUP BY traj_id, g),
 v AS (SELECT traj_id, count(*) + 1 AS n_messages, count(*) FILTER (bad) AS n_errors, count(*) FILTER (bad AND coalesce(nx, 'assistant') <> 'assistant') AS unanswered FROM n GROUP BY traj_id)
 SELECT v.traj_id, n_messages FROM v WHERE n_errors <= 8 AND unanswered = 0 AND coalesce((SELECT max(run) FROM i WHERE i.traj_id = v.traj_id), 0) <= 3""",
    "nat",
)
def clean_extraction(spark, d):
    """Analysis cut (some calls hold nothing else and go), training form, format and recovery checks.  Texts of users count
    as the assistant's here, so that errors are answered."""
    rows = native_messages(spark, d)
    rows = rows.withColumn("content", F.when((F.col("role") == "assistant") & (F.col("event_id") % 13 == 0), F.lit("## Error Analysis: none")).otherwise(F.col("content")))
    prompts = rows.select("traj_id").distinct().select("traj_id", F.lit("be kind\n## Error Analysis x").alias("prompt"))
    return training.clean_trajectories(rows, prompts).select("traj_id", F.size("messages").cast("long").alias("n_messages"))


@query("SELECT 'synthetic' AS source, 'shop' AS domain, count(*) AS n_messages, '[]' AS tools, '{\"id\": ' || conv_id || '}' AS statistics, '{}' AS user_info FROM conversations GROUP BY conv_id")
def unified_records(spark, d):
    lists = training.nested(conversation_messages(spark, d))
    records = lists.select("messages", F.lit(None).cast("string").alias("tools"), F.concat(F.lit('{"id": '), F.col("traj_id").cast("string"), F.lit("}")).alias("statistics"), F.lit(None).cast("string").alias("user_info"), F.lit(None).cast("string").alias("task_data"))
    out = training.unified_record(records, "shop")
    return out.select("metadata.source", "metadata.domain", F.size("messages").cast("long").alias("n_messages"), "tools", "metadata.statistics", "metadata.user_info")


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'real' ELSE 'kept' END AS source, CASE WHEN conv_id % 2 = 0 THEN 'shop' ELSE 'own' END AS domain FROM (SELECT DISTINCT conv_id FROM conversations)")
def with_source_rows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id").distinct()
    meta = F.when(F.col("conv_id") % 2 == 1, F.struct(F.lit("kept").alias("source"), F.lit("own").alias("domain")))
    return training.with_source(rows.withColumn("metadata", meta), "shop").select("conv_id", "metadata.source", "metadata.domain")


@query(
    """SELECT p_partkey, '{"type": "function", "function": {"name": "' || CASE WHEN p_partkey % 3 = 0 THEN 'unknown_function' ELSE p_brand END || '", "description": "' || CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END
 || '", "parameters": {"type": "object", "properties": ' || CASE WHEN p_partkey % 3 = 1 THEN '{"size":{"type":"integer"}}' ELSE '{}' END || ', "required": ' || CASE WHEN p_partkey % 3 = 1 THEN '["size"]' ELSE '[]' END || '}}}' AS tool FROM part"""
)
def api_tools(spark, d):
    kind = F.col("p_partkey") % 3
    full = F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "description": "'), "p_type", F.lit('", "parameters": {"properties": {"size":{"type":"integer"}}, "required": ["size"]}}'))
    api = F.when(kind == 0, F.lit("{}")).when(kind == 1, full).otherwise(F.concat(F.lit('{"name": "'), "p_brand", F.lit('"}')))
    return table(spark, d, "part").select("p_partkey", training.api_to_tool(api).alias("tool"))


@query("SELECT conv_id AS traj_id, string_agg(role || '=' || text, '|' ORDER BY turn) AS turns, true AS back FROM conversations GROUP BY conv_id")
def role_rename(spark, d):
    lists = training.nested(conversation_messages(spark, d)).withColumn("t", training.to_turns(F.col("messages")))
    return lists.select("traj_id", F.array_join(F.transform("t", lambda x: F.concat(x["from"], F.lit("="), x["value"])), "|").alias("turns"), (training.from_turns(F.col("t")) == F.col("messages")).alias("back"))


@query(
    """SELECT traj_id, string_agg(CASE WHEN kind = 'call' THEN 'look ' || '<tool_call>{"name": "' || name || '", "arguments": ' || replace(props, ': ', ':') || '}</tool_call>' || '<tool_call>{"name": "end", "arguments": {}}</tool_call>' ELSE content END, '|' ORDER BY idx) AS turns
 FROM evt WHERE idx > 0 GROUP BY traj_id""",
    "evt",
)
def legacy_call_turns(spark, d):
    """The first message of every user gets a role that is left out."""
    rows = event_messages(spark, d)
    listed = F.concat(F.lit('look <tool_calls>[{"function": {"name": "'), "name", F.lit('", "arguments": '), "props", F.lit('}}, {"function": {"name": "end", "arguments": {}}}]</tool_calls>'))
    turn = F.struct("idx", F.when(F.col("idx") == 0, "system").otherwise(F.col("role")).alias("from"), F.when(F.col("kind") == "call", listed).otherwise(F.col("content")).alias("value"))
    lists = rows.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("t"))
    out = lists.select("traj_id", training.legacy_turns(F.col("t")).alias("t")).where("size(t) > 0")
    return out.select("traj_id", F.array_join(F.transform("t", lambda t: t["value"]), "|").alias("turns"))


def _tasks(spark, d):
    """Orders as tasks: lines are actions, every third order lacks assertions, unknown information as text or items."""
    action = F.struct("pos", "name", "quantity", "discount", F.struct(F.lit(None).cast("string").alias("action_id"), "name", F.concat(F.lit('{"q": '), F.col("quantity").cast("string"), F.lit(', "d": "'), F.col("discount").cast("string"), F.lit('"}')).alias("arguments"), F.when(F.col("called"), F.col("pos")).alias("sequence_order")).alias("a"))
    lists = order_actions(spark, d).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(action)), lambda x: x["a"]).alias("actions"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority", "o_orderstatus")
    rows = lists.join(o, "task_id")
    unknown = F.when(F.col("task_id") % 2 == 0, F.lit('{"items": ["x", "y"]}')).otherwise(F.lit("plain"))
    instructions = F.struct(F.lit("shop").alias("domain"), F.concat(F.lit("change "), "o_orderpriority").alias("reason_for_call"), F.when(F.col("task_id") % 4 != 0, F.col("o_orderstatus")).alias("known_info"), F.lit("be brief").alias("task_instructions"), unknown.alias("unknown_info"))
    assertions = F.when(F.col("task_id") % 3 != 0, F.array(F.lit("no refund"), F.col("o_orderpriority")))
    return rows.select(
        F.col("task_id").cast("string").alias("id"), F.struct(F.lit("test").alias("purpose"), F.lit(None).cast("string").alias("relevant_policies"), F.lit(None).cast("string").alias("notes")).alias("description"),
        F.struct(F.lit("calm").alias("persona"), instructions.alias("instructions")).alias("user_scenario"), F.struct("actions", assertions.alias("nl_assertions")).alias("evaluation_criteria"),
    )


ORDER_TASKS = """o AS (SELECT o_orderkey AS task_id, o_orderpriority AS p, o_orderstatus AS s FROM orders), l AS (SELECT task_id, count(*) AS n, string_agg('  - ' || name || '(q=' || quantity || ', d=' || discount || ')', chr(10) ORDER BY pos, name, quantity, discount) AS lines, string_agg(name, '>' ORDER BY pos, name, quantity, discount) AS tools,
  string_agg(coalesce(CASE WHEN called THEN pos END, 999), ',' ORDER BY pos, name, quantity, discount) AS orders FROM ord GROUP BY task_id), t AS (SELECT * FROM o JOIN l USING (task_id))"""


@query(
    f"""WITH {ORDER_TASKS} SELECT CAST(task_id AS VARCHAR) AS task_id, orders, concat_ws(chr(10), '## Task Seed (MUST FOLLOW)', CASE WHEN task_id % 4 <> 0 THEN chr(10) || '**User Known Info:**' || chr(10) || s END,
 chr(10) || '**Reason for Call:**' || chr(10) || 'change ' || p, chr(10) || '**Additional Instructions:**' || chr(10) || 'be brief', chr(10) || '**Expected Action Sequence (YOU MUST FOLLOW):**' || chr(10) || lines,
 CASE WHEN task_id % 3 <> 0 THEN chr(10) || '**Constraints:**' || chr(10) || '  - no refund' || chr(10) || '  - ' || p END, chr(10) || '**Task Purpose:**' || chr(10) || 'test') AS prompt FROM t""",
    "ord",
)
def seed_prompts(spark, d):
    rows = training.seeds(_tasks(spark, d), "shop")
    return rows.select("task_id", F.array_join(F.transform("expected_actions", lambda a: a["sequence_order"].cast("string")), ",").alias("orders"), training.seed_prompt(rows).alias("prompt"))


@query(f"WITH {ORDER_TASKS} SELECT CAST(task_id AS VARCHAR) AS task_id, 'modification' AS task_type, CASE WHEN n <= 2 THEN 'simple' WHEN n <= 5 THEN 'medium' ELSE 'complex' END AS complexity, CASE WHEN task_id % 2 = 0 THEN 'x, y' ELSE 'plain' END AS unknown_info, tools, 'calm' AS persona FROM t", "ord")
def task_pattern_rows(spark, d):
    rows = training.task_patterns(_tasks(spark, d), "shop")
    return rows.select("task_id", "task_type", "complexity", "unknown_info", F.array_join("tool_sequence", ">").alias("tools"), "persona")


@query(
    """SELECT c_custkey, concat_ws(chr(10), 'Base of ' || c_mktsegment, 'Think first.', CASE WHEN c_custkey % 3 <> 2 THEN chr(10) || '## Tool-Specific Guidelines' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN '**get**:look' ELSE '**get**:look' || chr(10) || chr(10) || '**buy**:check' END END,
 CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '## Previous Analysis' || chr(10) || c_name || chr(10) || chr(10) || 'Follow these suggestions in this attempt.' END) AS prompt FROM customer"""
)
def system_prompts(spark, d):
    hints = F.create_map(F.lit("get"), F.lit("look"), F.lit("buy"), F.lit("check"))
    tools = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("get"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("buy"), F.lit("get"))).otherwise(F.array(F.lit("other")))
    analysis = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", training.system_prompt(F.concat(F.lit("Base of "), "c_mktsegment"), F.lit("Think first."), tools, hints, analysis).alias("prompt"))


@query(
    """SELECT p_partkey, concat_ws(chr(10), '## Failure Analysis', '- Task ID: ' || p_partkey, '- Attempt: ' || p_size, '- Reward: 0.50', '### Failure Reasons', p_type, '### Key Mistakes', '1. ' || p_brand || chr(10) || '2. b', '### Improvement Suggestions', '### Correct Approach Reference', 'ok') AS failure,
 concat_ws(chr(10), '## Contrast Analysis (Failed vs Successful)', '- Task ID: ' || p_partkey, '- Failed Attempt: ' || p_size, '- Reward: 0.50', '### Divergence Point', '### Why It Failed', p_type, '### Key Differences from Successful Trajectory', '### Correct Steps to Follow', '1. ' || p_brand, '### Critical Lesson', 'care') AS contrast FROM part"""
)
def analysis_markdown_rows(spark, d):
    reasons = F.concat(F.lit('{"failure_reasons": "'), "p_type", F.lit('", '))
    failure = F.concat(reasons, F.lit('"key_mistakes": ["'), "p_brand", F.lit('", "b"], "improvement_suggestions": [], "correct_approach": "ok"}'))
    contrast = F.concat(reasons, F.lit('"divergence_point": "", "correct_steps": ["'), "p_brand", F.lit('"], "critical_lessons": "care"}'))
    key, attempt, reward = F.col("p_partkey").cast("string"), F.col("p_size"), F.lit(0.5)
    return table(spark, d, "part").select("p_partkey", training.failure_markdown(key, attempt, reward, failure).alias("failure"), training.contrast_markdown(key, attempt, reward, contrast).alias("contrast"))
